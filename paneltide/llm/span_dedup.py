"""Substring dedup by sliding spans of consecutive sentences.

Every sentence that has enough words of its own is hashed, and from each shorter one the shortest
run that has enough sentences and words, and likewise back from it, so that a repeated passage is
covered up to both the ends of its whole sentences. All hashes are joined globally by one range-partitioned stream
(:mod:`first_seen`), and sentences covered by any run that is not the first of its hash go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common, first_seen

MIN_SENTENCES, MIN_WORDS = 2, 25
_STEP = 0xC2B2AE3D27D4EB4F


def sentences(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the first word of each sentence. A sentence ends at a word that ends in . ! or ?, at a line break, and with its text."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    stop = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8))
    breaks = np.r_[0, np.cumsum(raw == 10)]
    begin = np.zeros(n, bool)
    begin[0] = True
    begin[1:] = stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    begin[first[:-1][first[:-1] < n]] = True
    return np.flatnonzero(begin)


def _runs(begins: np.ndarray, text_of: np.ndarray, n_words: int, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first, last) of sentences: each sentence of sufficient words, and from each other one the shortest
    sufficient run on, and back, within one text."""
    n = len(begins)
    edge = np.r_[begins, n_words]
    i = np.arange(n)
    alone = np.diff(edge) >= least_words
    last = np.where(alone, i, np.maximum(np.searchsorted(edge, begins + least_words) - 1, i + least_sentences - 1))
    ok = last < n
    ok[ok] = text_of[last[ok]] == text_of[i[ok]]
    back = np.where(alone, i, np.minimum(np.searchsorted(edge, edge[1:] - least_words, "right") - 1, i - least_sentences + 1))
    fine = back >= 0
    fine[fine] = text_of[back[fine]] == text_of[i[fine]]
    pairs = np.r_[i[ok] * (n + 1) + last[ok], back[fine] * (n + 1) + i[fine]]
    pairs = np.unique(pairs)
    return pairs // (n + 1), pairs % (n + 1)


def _parts(texts: pa.Array, words: common.Words):
    raw, off = common.utf8(texts)
    starts, ends, first = words.spans(raw, off)
    begins = sentences(raw, starts, ends, first)
    text_of = np.searchsorted(first, begins, "right") - 1
    return raw, off, starts, ends, begins, text_of


def _span_rows(least_sentences: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        powers: list[np.ndarray] = []
        for whole in batches:
            for batch in common.slices(whole, "text"):
                raw, off, starts, ends, begins, text_of = _parts(pc.utf8_lower(batch.column("text")), words)
                n = len(starts)
                if not n:
                    continue
                a, b = _runs(begins, text_of, n, least_sentences, least_words)
                if not len(a):
                    continue
                if not powers or len(powers[0]) <= n:
                    powers = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)]) for base in (_STEP, pow(_STEP, -1, 1 << 64))]
                total = np.r_[np.uint64(0), np.cumsum(words.hashed(words.prefix(raw), starts, ends) * powers[0][:n])]
                edge = np.r_[begins, n]
                s, e = edge[a], edge[b + 1]
                h = common.mix((total[e] - total[s]) * powers[1][s])
                origin = np.searchsorted(text_of, np.arange(batch.num_rows))  # first sentence of each text
                row = text_of[a]
                take = pa.array(row.astype(np.int32))
                yield common.record(first_seen.ROW_SCHEMA, uid=batch.column("uid").take(take), doc=batch.column("doc").take(take), pos=(a - origin[row]).astype(np.int32), n=(b - origin[row]).astype(np.int32), h1=h.view(np.int64), h2=(e - s))

    return run


def repeated_spans(docs: DataFrame, least_sentences: int = MIN_SENTENCES, least_words: int = MIN_WORDS) -> DataFrame:
    """(uid, doc, spans): for each row with a repeated run, the runs (first, last sentence) that are not the first of their hash.

    Runs are ordered by doc_id (null before all), row key and place. Rows that agree in id and text are one here;
    :func:`dedup_spans` tells them apart.
    """
    slim = docs.select(common.row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc"), "text")
    rows = slim.mapInArrow(_span_rows(least_sentences, least_words), first_seen.ROWS)
    later = first_seen.later_occurrences(rows, 2, by_place=True)
    return later.groupBy("uid", "doc").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))


def _with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``again``: true for each but one of the rows that agree in doc and uid.

    Only such rows are written and numbered; all others pass as they are.
    """
    many = rows.groupBy("doc", "uid").agg(F.count("*").alias("_n")).filter("_n > 1")
    if many.isEmpty():
        return rows.withColumn("again", F.lit(False))
    many = common.written(many.select("doc", "uid"), "copies")
    once = rows.join(many, common.same_row(rows, many), "left_anti").withColumn("again", F.lit(False))
    copies = common.written(rows.join(many, common.same_row(rows, many), "left_semi").withColumn("_tag", F.monotonically_increasing_id()), "copies")
    first = common.written(copies.groupBy("doc", "uid").agg(F.min("_tag").alias("_first")), "copies")
    told = copies.join(first, common.same_row(copies, first)).select(*[copies[c] for c in rows.columns], (F.col("_tag") != F.col("_first")).alias("again"))
    return once.unionByName(told)


def _remover(least_sentences: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for whole in batches:
            for batch in common.slices(whole, "t"):
                yield _removed(batch, words, least_sentences, least_words)

    return run


def _removed(batch: pa.RecordBatch, words: common.Words, least_sentences: int, least_words: int) -> pa.RecordBatch:
    texts = batch.column("t")
    raw, off, starts, ends, begins, text_of = _parts(texts, words)  # sentences do not depend on case
    data = raw.tobytes()
    origin = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
    spans = batch.column("spans").to_pylist()
    again = np.flatnonzero(batch.column("again").to_numpy(zero_copy_only=False))
    if again.size:  # every run of a copy is there already
        runs = np.stack(_runs(begins, text_of, len(starts), least_sentences, least_words), 1)
        bounds = np.searchsorted(runs[:, 0], origin)  # runs are in order of their first sentence
        for i in again.tolist():
            mine = runs[bounds[i] : bounds[i + 1]] - origin[i]
            spans[i] = [{"pos": int(p), "n": int(n)} for p, n in mine]
    kept, count, gone, where = [], [], [], []
    for i in range(batch.num_rows):
        a, b = int(off[i]), int(off[i + 1])
        firsts = begins[origin[i] : origin[i + 1]]
        count.append(len(firsts))
        if not spans[i]:
            kept.append(None if not texts[i].is_valid else data[a:b].decode())
            gone.append(0)
            where.append("")
            continue
        cut = np.zeros(len(firsts) + 1, np.int64)
        for s in spans[i]:
            cut[s["pos"]] += 1
            cut[s["n"] + 1] -= 1
        cut = np.cumsum(cut[:-1]) > 0
        at = np.r_[starts[firsts], b]  # a sentence reaches up to the next one
        at[0] = a if cut[0] else at[0]
        text, spots, last, chars = [], [], a, 0
        for k in np.flatnonzero(cut & ~np.r_[False, cut[:-1]]):
            stop = k
            while stop < len(cut) and cut[stop]:
                stop += 1
            before, inside = data[last : at[k]].decode(), data[at[k] : at[stop]].decode()
            text.append(before)
            chars += len(before)
            spots.append(f"{chars}:{chars + len(inside)}")
            chars += len(inside)
            last = at[stop]
        text.append(data[last:b].decode())
        kept.append("".join(text))
        gone.append(int(cut.sum()))
        where.append(",".join(spots))
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.string())], names=["row", "text", "n_sentences", "n_removed", "removed"])


def dedup_spans(docs: DataFrame, least_sentences: int = MIN_SENTENCES, least_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text), ``text`` without the repeated sentences, n_sentences, n_removed, removed.

    ``removed`` lists start:end in code points of the original text. Of equal runs the one of the smallest doc_id (null
    before all), row key and place stays. Of rows that agree in id and text one counts as the first; the others lose every
    sentence that a run covers. Null text stays null, empty text stays empty: neither has a sentence. An empty table stays empty.
    """
    spans = repeated_spans(docs, least_sentences, least_words)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(common.row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc"), F.struct(*others).alias("row"), F.col("text").alias("t"))
    rows = _with_copies(rows)
    kind = rows.select("row").schema["row"].dataType.simpleString()
    rows = rows.join(spans, common.same_row(rows, spans), "left").select("row", "t", "spans", "again")
    return rows.mapInArrow(_remover(least_sentences, least_words), f"row {kind}, text string, n_sentences long, n_removed long, removed string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``. Null text: null, no sentence, none removed; very long texts are read whole;
    an empty table gives none; other columns are ignored. See :func:`dedup_spans` for ties and repeated rows."""
    out = dedup_spans(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_sentences", "n_removed", "removed", "text")
