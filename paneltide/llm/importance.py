"""Importance resampling towards a target: hashed word runs, bucket weights, and a draw without replacement.

1. *Streaming CRC ring.* One scan of a text keeps the running CRC-32 states of the runs that began at its last n words.
   Each new word starts a state and extends the others by a space and itself, so every run of 1 to n words has its
   checksum without ever being put together; the checksum picks its bucket.
2. Bucket counts of the corpus and of the target (as many numbers as buckets, whatever the size) give each bucket's gain,
   the logarithm of how much more frequent it is in the target, smoothed by one.
3. A second scan averages the gains of each text's runs. The average plus Gumbel noise, made from the document's id, is a
   score; the highest scores are a draw with odds by weight. Ranks come from a sort by range partitions.

Texts are scanned in place and never shuffled; what is sorted is five numbers a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm import common, lookup

RUN, BUCKETS = 2, 10_000
LEAST_WORDS, SHARE, SEED = 20, 25, 7

#: Bytes to bytes: A-Z to lower case; ASCII letters and digits and all bytes beyond ASCII are parts of words, the rest separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Ring:
    """Buckets of all runs of 1 to ``n`` words of a text, in order of their last word and, within that, the shortest first."""

    def __init__(self, n: int = RUN, buckets: int = BUCKETS) -> None:
        self.n, self.buckets = n, buckets

    def scan(self, text: bytes | None) -> Iterator[tuple[np.ndarray, int]]:
        """(buckets, number of words) of one stretch of the text after the other."""
        crc, n, states = zlib.crc32, self.n - 1, []
        for words in common.byte_words((text or b"").translate(_WORD_BYTES)):
            found: list[int] = []
            for word in words:
                states = [crc(b" " + word, s) for s in states[:n]] if n else []
                states.insert(0, crc(word))
                found += states
            yield np.array(found, np.int64) % self.buckets, len(words)


def _counts(ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(ring.buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                for found, _ in ring.scan(text.as_py()):
                    waiting.append(found)
                    size += len(found)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(waiting), minlength=ring.buckets)
                        waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=ring.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (column ``text``); buckets that no run falls into are left out."""
    found = texts.select("text").mapInArrow(_counts(Ring(run, buckets)), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, in whole thousandths: the log ratio of its smoothed shares in the target and in the corpus."""
    both = []
    for texts in (corpus, target):
        held = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, run, buckets).collect():  # at most one row for each bucket
            held[row["bucket"]] = row["n"]
        both.append(held.tolist())
    s, t = both
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def _weights(ring: Ring, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_features", "weight"]
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.large_binary()):
                words = features = total = 0
                for found, n in ring.scan(text.as_py()):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                rows.append((words, features, total // features if features else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)

    return run


def weighed(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for each row of ``docs``; weight is the floored mean gain, 0 without words.

    Null texts are empty; texts are scanned whole, of any length; an empty target or table is fine (all counts 0).
    """
    gain = gains(docs, target, run, buckets)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_weights(Ring(run, buckets), gain), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of sha256(``seed:doc_id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """``scored`` (doc_id, n_words, score and more) with ``rank``: 1, 2, 3... for the floor(share * N / 100) highest scores of
    the N rows of at least ``least_words`` words, ties to the smaller doc_id (null first), then in any fixed order; else null."""
    kept = common.written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    most = share * kept.filter(fit).count() // 100
    placed = lookup.ranked(kept.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row").asc()])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(kept.filter(~fit).withColumn("rank", F.lit(None).cast("long"))).drop("_row")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all rows of ``docs``; see :func:`weighed` and :func:`drawn`."""
    scored = weighed(docs, target)
    return drawn(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), share=share)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``. Null and empty texts have no feature and weight 0; very long texts are
    scanned whole; repeated rows are drawn each; a null doc_id hashes as nothing; an empty table gives none; other columns are ignored."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
