"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Training takes at most this many documents of each label, of at most this many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 40_000


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % parts


def _known(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.filter(fold(parts=parts) != held).groupBy("doc_id").agg(F.max("label").alias("label"))


def counts(labels: DataFrame, label: str, parts: int, held: int) -> tuple[int, int]:
    """Number of labelled documents of label 0 and of label 1 outside the held fold, at any number of them."""
    n = {r["label"]: r["count"] for r in _known(labels, label, parts, held).groupBy("label").count().collect()}
    return n.get(0, 0), n.get(1, 0)


def prior_shift(y: np.ndarray, counts: tuple[int, int] | None) -> float:
    """What log odds fitted on a sample of labels ``y`` lack to those of all ``counts`` documents; 0 where a label is absent."""
    seen = np.bincount(y, minlength=2)
    if counts is None or not seen.all() or not all(counts):
        return 0.0
    return float(np.log(counts[1] / counts[0]) - np.log(seen[1] / seen[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of training documents: those whose id's fold is not ``held``, each text once, the same at every run.

    The first ``most`` documents of each label, in the order of a hash of the id, of those of at most ``chars`` characters. Twice
    as many ids are looked up, so that longer texts leave no gap (were more than half of all texts longer, the sample would be
    smaller). An id counts once, by its least text, however often it is repeated, so the driver gets ``2 * most`` texts at most.
    The cap holds for each label, so the sample has another share of label 1 than the table; :func:`prior_shift` restores it.
    """
    known = _known(labels, label, parts, held)
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(2 * most) for v in (0, 1)]
    few = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= chars)
    one = texts.join(F.broadcast(few), "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text")).withColumn("at", order)
    place = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    rows = one.withColumn("place", place).filter(F.col("place") <= most).collect()
    once: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["doc_id"], r["label"])):
        once.setdefault(r["text"], r["label"])
    return list(once.items())
