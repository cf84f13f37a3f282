"""Toxic spans by a linear-chain conditional random field.

Labels come for whole documents, so tokens are labelled first: a greedy cover picks the words and
word beginnings that explain the most toxic documents and hardly any other, and the tokens that
carry them are the toxic ones. A two-state chain over word, prefix and suffix features is trained
on those tokens. Forward-backward over the whole text gives each token's marginal; a document's
score is a calibrated function of the sum of its tokens' squared marginals (a doubtful token counts
little, none is cut off), and tokens over one half are its offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm import common, labelled

PARTS, HELD = 4, 2
THRESHOLD = 0.3
BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
#: Training takes at most this many documents of each label, of at most this many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 10_000
#: Training also takes at most this many windows and words or word beginnings of the cover.
CHAINS, RULES = 5000, 200
#: Tokens of a matrix row. A longer text is several rows, and the chain's state is carried from each to the next, both ways.
WINDOW = 64
#: Tokens whose codes are sorted or looked up at once in training, which runs beside the driver's JVM.
PIECE = 1 << 16
#: Bytes of text scored at once; features and chain take about 60 bytes for each of them.
SLICE_BYTES = 1 << 20


def features(texts: pa.Array, words: common.Words):
    """(raw, starts, ends, first, codes): codes is tokens x features, 64-bit, 0 where a word is too short for one."""
    raw, off = common.utf8(pc.utf8_lower(texts))
    a, b, first = words.spans(raw, off)
    # Punctuation at the end of a word is not part of it.
    for _ in range(3):
        b = np.where((b - a > 1) & np.isin(raw[b - 1], np.frombuffer(b".,;:!?)\"'*$%&#|", np.uint8)), b - 1, b) if len(b) else b
    prefix = words.prefix(raw)
    codes = np.zeros((len(a), len(PREFIXES) + 2), np.uint64)
    codes[:, 0] = words.hashed(prefix, a, b)
    for j, n in enumerate(PREFIXES, 1):
        long = b - a > n
        codes[long, j] = words.hashed(prefix, a[long], a[long] + n) + np.uint64(j)
    long = b - a > 3
    codes[long, -1] = words.hashed(prefix, b[long] - 3, b[long]) ^ np.uint64(0x5851F42D4C957F2D)
    return raw, a, b, first, codes


def _held(doc: np.ndarray, codes: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their distinct codes (not 0), in order of both. ``doc`` ascends; about ``most`` tokens are sorted at once."""
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.uint64))]
    a = 0
    while a < len(doc):
        b = int(np.searchsorted(doc, doc[min(a + most, len(doc)) - 1], "right"))  # a document is not cut
        row, col = np.nonzero(codes[a:b])
        owner, code = doc[a:b][row].astype(np.int32), codes[a:b][row, col]
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])][: len(owner)]
        parts.append((owner[new], code[new]))
        a = b
    return np.concatenate([o for o, _ in parts]), np.concatenate([c for _, c in parts])


def _among(codes: np.ndarray, lexicon: np.ndarray, most: int = PIECE) -> np.ndarray:
    """Flags of rows that hold a code of ``lexicon`` (in order), some rows at a time."""
    out = np.zeros(len(codes), bool)
    for a in range(0, len(codes) if len(lexicon) else 0, most):
        some = codes[a : a + most]
        out[a : a + most] = (lexicon[np.minimum(np.searchsorted(lexicon, some), len(lexicon) - 1)] == some).any(1)
    return out


def _cover(doc: np.ndarray, codes: np.ndarray, toxic: np.ndarray, least: int = 3, most_rules: int = RULES) -> np.ndarray:
    """Codes of toxic words and word beginnings: those far too frequent in toxic documents to be chance, and a
    greedy cover of the toxic documents by codes that each explain at least ``least`` more and are rare elsewhere."""
    owner, code = _held(doc, codes[:, :-1])
    names = np.unique(code)
    which = np.searchsorted(names, code).astype(np.int32)
    del code
    bad = np.bincount(which, weights=toxic[owner], minlength=len(names))
    good = np.bincount(which, weights=1 - toxic[owner], minlength=len(names))
    share = max(1, int((1 - toxic).sum())) / max(1, int(toxic.sum()))
    fine = (bad >= least) & (good / share <= 0.05 * bad)
    rate = max(1e-6, toxic.mean())
    sure = fine & (bad * np.log(1 / rate) + good * np.log(1 - rate) >= 14)
    keep = fine[which] & (toxic[owner] == 1)
    owner, which = owner[keep], which[keep]
    left = np.ones(len(toxic), bool)
    chosen: list[int] = []
    while len(chosen) < most_rules and len(owner):
        gain = np.bincount(which, weights=left[owner], minlength=len(names)) - good / share
        pick = int(np.argmax(gain))
        if gain[pick] < least:
            break
        chosen.append(pick)
        left[owner[which == pick]] = False
    return names[np.union1d(np.flatnonzero(sure), chosen).astype(int)]


def distinct_texts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of texts that share none of four least shingle hashes with an earlier text: near copies would pass for evidence."""
    g, d = common.windows(hashes, first, 5)
    n = len(first) - 1
    fresh = np.ones(n, bool)
    if not len(g):
        return fresh
    some = np.unique(d)
    begins = np.searchsorted(d, some)
    for salt in range(1, 5):
        least = np.minimum.reduceat(common.mix(g ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))), begins)
        fresh[np.setdiff1d(some, some[np.unique(least, return_index=True)[1]])] = False
    return fresh


def chains(first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of each token in a (rows x window) matrix, and each row's number within its text."""
    n = np.diff(first)
    rows_of = -(-n // window)
    start = np.cumsum(rows_of) - rows_of
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(start, n) + place // window, place % window, np.arange(rows_of.sum()) - np.repeat(start, rows_of)


def marginals(score: np.ndarray, mask: np.ndarray, trans: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token and the expected transitions (2x2) of rows x window emissions.

    ``part``: each row's number within its text (all 0 if not given); rows with a larger one go on where the row before
    ended. First every row's transfer matrices are multiplied up, side by side for all rows; then the state is passed from
    row to row; then both give the marginals.
    """
    rows, width = score.shape
    part = np.zeros(rows, np.int64) if part is None else part
    step = np.exp(trans)
    weight = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], 2)
    prefix = np.zeros((width, rows, 2, 2))
    now = np.where((part == 0)[:, None, None], 1.0, step[None]) * weight[:, 0, None, :]
    for t in range(width):
        if t:
            then = (now[:, :, 0, None] * step[0] + now[:, :, 1, None] * step[1]) * weight[:, t, None, :]
            now = np.where(mask[:, t, None, None], then / then.sum((1, 2), keepdims=True), now)
        prefix[t] = now
    begin, end = np.full((rows, 2), 0.5), np.ones((rows, 2))
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(part.max(initial=0) + 2))
    for k in range(1, len(edges) - 1):
        r = order[edges[k] : edges[k + 1]]
        v = (begin[r - 1, :, None] * now[r - 1]).sum(1)
        begin[r] = v / v.sum(1, keepdims=True)
    for k in range(len(edges) - 2, 0, -1):
        r = order[edges[k] : edges[k + 1]]
        v = (now[r] * end[r, None, :]).sum(2)
        end[r - 1] = v / v.sum(1, keepdims=True)
    p = np.zeros((rows, width))
    pairs = np.zeros((2, 2))
    beta = end
    for t in range(width - 1, -1, -1):
        live = mask[:, t]
        g = (begin[:, :, None] * prefix[t]).sum(1) * beta
        p[:, t] = np.where(live, g[:, 1] / np.maximum(g.sum(1), 1e-300), 0)
        w = weight[:, t] * beta
        before = (begin[:, :, None] * prefix[t - 1]).sum(1) if t else begin
        joint = before[:, :, None] * step[None] * w[:, None, :]
        joint /= np.maximum(joint.sum((1, 2)), 1e-300)[:, None, None]
        pairs += joint[live if t else live & (part > 0)].sum(0)
        new = np.stack([(step[0] * w).sum(1), (step[1] * w).sum(1)], 1)
        beta = np.where(live[:, None], new / np.maximum(new.sum(1, keepdims=True), 1e-300), beta)
    return p, pairs


def _emissions(codes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    slot = (codes >> np.uint64(64 - BITS)).astype(np.int64)
    return (weights[slot] * (codes != 0)).sum(1) + bias


def _train(first: np.ndarray, codes: np.ndarray, toxic: np.ndarray, rounds: int, chains_most: int) -> dict:
    """Weights, bias and transitions from texts (``first``: index of each one's first token) and their labels.

    Trains on the windows with toxic tokens and on others in hash order, ``chains_most`` at most, each as a chain of its own.
    """
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    alone = distinct_texts(codes[:, 0], first)[doc]
    lexicon = _cover(doc[alone], codes[alone], toxic)
    hit = _among(codes[:, :-1], lexicon)
    label = hit & (toxic[doc] == 1)
    known = (toxic[doc] == 0) | (np.bincount(doc, weights=label, minlength=len(toxic)) > 0)[doc]
    row, col, part = chains(first)
    n = len(part)
    has = np.bincount(row, weights=label, minlength=n) > 0
    usable = np.bincount(row, weights=~known, minlength=n) == 0
    order = np.argsort(common.mix(np.arange(n, dtype=np.uint64)))
    order = np.r_[order[has[order]], order[~has[order] & usable[order]]][:chains_most]
    at = np.full(n, -1)
    at[order] = np.arange(len(order))
    inside = at[row] >= 0
    r, c, y = at[row[inside]], col[inside], label[inside].astype(float)
    slot = (codes[inside] >> np.uint64(64 - BITS)).astype(np.int64)
    there = codes[inside] != 0
    # Half of the tokens are seen without their whole word, so beginnings and ends carry weight of their own.
    there[common.mix(np.arange(len(there), dtype=np.uint64)) >> np.uint64(63) == 1, 0] = False
    mask = np.zeros((len(order), WINDOW), bool)
    mask[r, c] = True
    truth = np.zeros((len(order), WINDOW))
    truth[r, c] = y
    follow = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[(follow & (truth[:, :-1] == i) & (truth[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    w, bias, trans = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    total = max(1.0, y.sum())
    m = [np.zeros(1 << BITS), 0.0, np.zeros((2, 2))]
    v = [np.zeros(1 << BITS), 0.0, np.zeros((2, 2))]
    for it in range(1, rounds + 1):
        score = np.zeros((len(order), WINDOW))
        score[r, c] = (w[slot] * there).sum(1) + bias
        p, pairs = marginals(score, mask, trans)
        err = p[r, c] - y
        grads = (np.bincount(slot.reshape(-1), weights=(err[:, None] * there).reshape(-1), minlength=1 << BITS) / total + 2e-4 * w, err.sum() / total, (pairs - seen) / total + 1e-3 * trans)
        new = []
        for i, (value, g) in enumerate(zip((w, bias, trans), grads)):
            m[i] = 0.8 * m[i] + 0.2 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            new.append(value - 0.25 * (m[i] / (1 - 0.8**it)) / (np.sqrt(v[i] / (1 - 0.99**it)) + 1e-8))
        w, bias, trans = new
    return {"weights": w.astype(np.float32), "bias": float(bias), "trans": trans}


def fit(sample: list[tuple[str, int]], rounds: int = 30, chains_most: int = CHAINS, counts: tuple[int, int] | None = None) -> dict:
    """The model: hashed weights, bias, transitions, and the calibration of document scores.

    ``counts``: documents of label 0 and 1 that the sample stands for; scores are probabilities among those. The
    calibration is fitted to each half of the sample as scored by a model of the other half, so what a model has learnt
    by heart does not count as evidence.
    """
    toxic = np.array([y for _, y in sample], np.int64)
    if not len(sample) or not toxic.any() or toxic.all():
        clean_n, toxic_n = counts or ((1 - toxic).sum(), toxic.sum())
        scale = (0.0, float(np.log((toxic_n + 1) / (clean_n + 1))) if len(sample) else -2.0)
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": -8.0, "trans": np.zeros((2, 2)), "scale": scale}
    words = common.Words()
    parts = [features(pa.array([t for t, _ in sample[i : i + 200]], pa.string()), words)[3:] for i in range(0, len(sample), 200)]
    lengths = np.concatenate([np.diff(f) for f, _ in parts])
    first = np.cumsum(np.r_[0, lengths])
    codes = np.concatenate([c for _, c in parts])
    del parts
    model = _train(first, codes, toxic, rounds, chains_most)
    # Equal shares of both labels in each half.
    half = np.zeros(len(toxic), bool)
    for y in (0, 1):
        half[np.flatnonzero(toxic == y)[::2]] = True
    x = np.zeros(len(toxic))
    for side in (half, ~half):
        if toxic[~side].any() and not toxic[~side].all():
            other = np.repeat(~side, lengths)
            judge = _train(np.cumsum(np.r_[0, lengths[~side]]), codes[other], toxic[~side], rounds, chains_most // 2)
        else:
            judge = model
        x[side] = evidence(np.cumsum(np.r_[0, lengths[side]]), codes[np.repeat(side, lengths)], judge)[0]
    slope, intercept = calibrate(x, toxic)
    return {**model, "scale": (slope, intercept + labelled.prior_shift(toxic, counts))}


def evidence(first: np.ndarray, codes: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sum of squared marginals of each text, and each token's marginal."""
    n = len(first) - 1
    row, col, part = chains(first)
    p = np.zeros(len(codes))
    if len(part):
        score, mask = np.zeros((len(part), WINDOW)), np.zeros((len(part), WINDOW), bool)
        score[row, col] = _emissions(codes, model["weights"], model["bias"])
        mask[row, col] = True
        p = marginals(score, mask, model["trans"], part)[0][row, col]
    doc = np.repeat(np.arange(n), np.diff(first))
    return np.log(np.bincount(doc, weights=p * p, minlength=n) + 1e-4), p


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from evidence to label, by Newton steps."""
    mean, spread = float(x.mean()), float(x.std() + 1e-9)
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (q * (1 - q))[:, None]).T @ z + ridge * np.eye(2)
        b = b - np.linalg.solve(h, z.T @ (q - y) + ridge * b)
    return float(b[0] / spread), float(b[1] - b[0] * mean / spread)


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        slope, shift = model["scale"]
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                texts = batch.column("text")
                raw, a, b, first, codes = features(texts, words)
                x, p = evidence(first, codes, model)
                score = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
                spans = [""] * batch.num_rows
                hot = np.flatnonzero(p >= 0.5)
                if hot.size:
                    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
                    base = common.utf8(pc.utf8_lower(texts))[1]
                    owner = np.searchsorted(first, hot, "right") - 1
                    for t, o in zip(hot.tolist(), owner.tolist()):
                        at = chars[base[o]]
                        spans[o] += f"{',' if spans[o] else ''}{chars[a[t]] - at}:{chars[b[t]] - at}"
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score), pa.array(spans, pa.string())], names=["row", "score", "spans"])

    return run


def _scored(docs: DataFrame, row: Column, model: dict) -> DataFrame:
    rows = docs.select(row.alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double, spans string")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``row`` (all columns of ``docs``), ``score`` from 0 to 1 and ``spans`` (start:end of the offending words, in code points).

    Null and empty texts have no token and get the least score. Repeated rows are scored each; an
    empty table stays empty; columns of any name stay inside ``row``.
    """
    return _scored(docs, F.struct("*"), model)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    sample = labelled.sample(docs, labels, "toxic", PARTS, HELD, SAMPLE_DOCS, SAMPLE_CHARS)
    return fit(sample, counts=labelled.counts(labels, "toxic", PARTS, HELD))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``. Null and empty texts get the least score, a null id is not held out,
    very long texts are read whole, repeated rows are scored each, an empty table gives none; other columns are ignored."""
    out = _scored(docs, F.struct("doc_id"), train(docs, labels))
    held = F.coalesce(labelled.fold("row.doc_id", PARTS) == HELD, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
