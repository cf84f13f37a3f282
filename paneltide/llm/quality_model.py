"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics (log counts, log odds of ratios).
Each class is a Gaussian whose covariance is shrunk towards the pooled one and its diagonal; the
Cholesky factors are computed once, and a document's score is the calibrated difference of the two
log densities, each a Mahalanobis distance by one triangular product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm import common, labelled
from paneltide.llm.quality_rules import STOP_WORDS
from paneltide.llm.toxicity import calibrate

PARTS, HELD = 5, 0
THRESHOLD = 0.3
SHRINK = 0.1

NAMES = (
    "log_words log_mean_word log_mean_line upper digit symbol mark bang bar space wide stop distinct repeated top_word "
    "short_word long_word capital line_repeat word_spread"
).split()


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed so that none and all stay finite."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(texts: pa.Array, words: common.Words) -> np.ndarray:
    """Texts x statistics; whole texts, null as empty."""
    n = len(texts)
    raw, off = common.utf8(texts)
    a, b, first = words.spans(raw, off)
    lowered, low_off = common.utf8(pc.utf8_lower(texts))
    la, lb, _ = words.spans(lowered, low_off)
    h = words.hashed(words.prefix(lowered), la, lb)
    per_text = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][off]).astype(float)
    per_word = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][first]).astype(float)
    size, count = np.diff(off).astype(float), np.diff(first).astype(float)
    table = np.zeros((7, 256), bool)
    table[0, 65:91] = True
    table[1, 48:58] = True
    table[2, list(b"#*$%&<>~^=+_{}[]\\/@")] = True
    table[3, list(b".,;:?'\"()-")] = True
    table[4, ord("!")] = True
    table[5, ord("|")] = True
    table[6] = words.space
    upper, digit, symbol, mark, bang, bar, space = (per_text(t[raw]) for t in table)
    wide = per_text(raw >= 128)
    lines = per_text(raw == 10) + 1
    length = (b - a).astype(float)
    chars = per_word(length)
    square = per_word(length * length)
    mean = chars / np.maximum(count, 1)
    stop_hash = words.words(pa.array([" ".join(dict.fromkeys(STOP_WORDS))]))[0]
    stop = per_word(np.isin(h, stop_hash))
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(doc[order][new], minlength=n).astype(float)
    top = np.zeros(n)
    if len(h):
        np.maximum.at(top, doc[order][new], np.diff(np.r_[np.flatnonzero(new), len(h)]).astype(float))
    g, gd = common.windows(h, first, 5)
    order = np.lexsort((g, gd))
    again = np.r_[False, (g[order][1:] == g[order][:-1]) & (gd[order][1:] == gd[order][:-1])] if len(g) else np.zeros(0, bool)
    repeated = np.bincount(gd[order][again], minlength=n).astype(float)
    grams = np.bincount(gd, minlength=n).astype(float)
    breaks = np.flatnonzero(raw == 10)
    begin = np.sort(np.r_[off[:-1], breaks + 1])
    end = np.r_[begin[1:], len(raw)]
    owner = np.searchsorted(off[1:], begin, "right")
    line = words.hashed(words.prefix(raw), begin[owner < n], end[owner < n])
    owner = owner[owner < n]
    order = np.lexsort((line, owner))
    same = np.r_[False, (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])] if len(line) else np.zeros(0, bool)
    line_repeat = np.bincount(owner[order][same], minlength=n).astype(float)
    columns = [
        np.log1p(count),
        np.log(mean + 0.5),
        np.log((count + 1) / lines),
        _odds(upper, size),
        _odds(digit, size),
        _odds(symbol, size),
        _odds(mark, size),
        _odds(bang, size),
        _odds(bar, size),
        _odds(space, size),
        _odds(wide, size),
        _odds(stop, count),
        _odds(distinct, count),
        _odds(repeated, grams),
        _odds(top, count),
        _odds(per_word(length <= 2), count),
        _odds(per_word(length >= 12), count),
        _odds(per_word((raw[a] >= 65) & (raw[a] <= 90)) if len(a) else count, count),
        _odds(line_repeat, lines),
        np.log1p(np.maximum(square / np.maximum(count, 1) - mean * mean, 0)),
    ]
    return np.stack(columns, 1)


def fit(sample: list[tuple[str, int]], shrink: float = SHRINK, counts: tuple[int, int] | None = None) -> dict:
    """Means and inverse Cholesky factors of both classes, and the calibration of their log density difference.

    ``counts``: documents of label 0 and 1 that the sample stands for; scores are probabilities among those.
    """
    y = np.array([label for _, label in sample], np.int64)
    if len(sample) < 4 or not y.any() or y.all():
        n0, n1 = counts or (len(y) - y.sum(), y.sum())
        share = (n1 + 1) / (n0 + n1 + 2) if len(y) else 0.5
        return {"classes": None, "scale": (0.0, float(np.log(share / (1 - share))))}
    words = common.Words()
    x = np.concatenate([statistics(pa.array([t for t, _ in sample[i : i + 500]], pa.string()), words) for i in range(0, len(sample), 500)])
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / spread
    residual = np.concatenate([z[y == k] - z[y == k].mean(0) for k in (0, 1)])
    pooled = residual.T @ residual / len(residual)
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled) + 1e-3)
    classes = []
    for k in (0, 1):
        part = z[y == k]
        d = part - part.mean(0)
        own = d.T @ d / len(part)
        weight = min(1.0, shrink + z.shape[1] / len(part))  # few rows lean on the target
        factor = np.linalg.cholesky((1 - weight) * own + weight * target)
        classes.append((part.mean(0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    model = {"centre": centre, "spread": spread, "classes": classes, "scale": (1.0, 0.0)}
    slope, intercept = calibrate(evidence(x, model), y)
    model["scale"] = (slope, intercept + labelled.prior_shift(y, counts))
    return model


def evidence(x: np.ndarray, model: dict) -> np.ndarray:
    """Log density difference of class 1 and class 0, in signed square roots so that far outliers do not rule the calibration."""
    if model["classes"] is None:
        return np.zeros(len(x))
    z = (x - model["centre"]) / model["spread"]
    log_density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - log_det for mean, inverse, log_det in model["classes"]]
    diff = log_density[1] - log_density[0]
    return np.sign(diff) * np.sqrt(np.abs(diff))


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        slope, shift = model["scale"]
        for whole in batches:
            for batch in common.slices(whole, "text"):
                x = evidence(statistics(batch.column("text"), words), model)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30))))], names=["row", "score"])

    return run


def _scored(docs: DataFrame, row: Column, model: dict) -> DataFrame:
    rows = docs.select(row.alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score`` from 0 to 1, higher for label 1.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows are scored
    each; an empty table stays empty; columns of any name stay inside ``row``.
    """
    return _scored(docs, F.struct("*"), model)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(labelled.sample(docs, labels, "quality", PARTS, HELD), counts=labelled.counts(labels, "quality", PARTS, HELD))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``. Null and empty texts are scored as an empty text, a null id is not held
    out, very long texts are read whole, repeated rows are scored each, an empty table gives none; other columns are ignored."""
    out = _scored(docs, F.struct("doc_id"), train(docs, labels))
    held = F.coalesce(labelled.fold("row.doc_id", PARTS) == HELD, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
