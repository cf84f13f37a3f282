"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be matched with k errors. It is split into k + 1 pieces: an
occurrence with at most k errors leaves at least one piece untouched, so exact piece hits (one
Aho-Corasick pass over each text) find every candidate, and Myers' bit-parallel algorithm verifies
the edit distance in the window around it. Texts are compared lower-cased with white space
collapsed. Items are handed to the executors in broadcast blocks of bounded size, one at a time on the
driver, however many there are; the items of one block share one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common

ERROR_RATE = 0.08
#: Characters of test items that one pass over the documents looks for; more are searched in further passes.
BLOCK_CHARS = 2_000_000
#: Items of fewer words are not searched for: a word or two occur in clean texts too, and are evidence of nothing.
MIN_WORDS = 5

MATCHES = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Start and end of ``errors + 1`` pieces of nearly equal length, none of them empty."""
    n = min(errors + 1, length)
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def alphabet_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and the end of the first such substring."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the approximate occurrences of test items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for a, b in pieces(len(text), errors):
                where.setdefault(text[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, spots)
        if where:
            self.automaton.make_automaton()
        self.masks: dict[int, tuple[dict, dict]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item in a normalised text."""
        if not self.items or not text:
            return []
        tried: dict[int, list[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for last, spots in self.automaton.iter(text):
            for n, b in spots:
                at = last + 1 - b  # where the item would begin without errors before this piece
                k = self.items[n][2]
                near = tried.setdefault(n, [])
                if any(abs(at - x) <= k for x in near[-4:]):
                    continue
                near.append(at)
                got = self.verify(n, text, at)
                if got and (n not in best or got < best[n]):
                    best[n] = got
        return [(self.items[n][0], *got) for n, got in best.items()]

    def verify(self, n: int, text: str, at: int) -> tuple[int, int, int] | None:
        _, item, k = self.items[n]
        m = len(item)
        lo, hi = max(0, at - 2 * k), min(len(text), at + m + 2 * k)  # also covers hits up to k away
        exact = text.find(item, lo, hi)
        if exact >= 0:
            return 0, exact, exact + m
        if not k:
            return None
        if n not in self.masks:
            self.masks[n] = alphabet_masks(item), alphabet_masks(item[::-1])
        forward, backward = self.masks[n]
        distance, end = myers(forward, m, text[lo:hi])
        if distance > k:
            return None
        end += lo
        _, length = myers(backward, m, text[max(lo, end - m - k) : end][::-1])
        return distance, end - length, end


def _match(items: Broadcast, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, error_rate)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        for whole in batches:
            for batch in common.slices(whole, "text"):
                rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in matcher.find(normal(text))]
                if rows:
                    yield common.record(schema, **dict(zip(schema.names, zip(*rows))))

    return run


def _blocks(items: DataFrame, min_words: int) -> Iterator[Broadcast]:
    """All items of enough words, in broadcast lists of about ``BLOCK_CHARS`` characters."""
    slim = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    chars = slim.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for b in range(n):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        block = [(r["item_id"], normal(r["text"])) for r in rows]
        yield items.sparkSession.sparkContext.broadcast([(i, t) for i, t in block if t.count(" ") + 1 >= min_words])


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of each item in each document that has one.

    An item of m characters occurs where the edit distance is at most ``int(m * error_rate)``;
    start and end count characters of the normalised text. Null and blank texts and items match
    nothing, nor do items of fewer than ``min_words`` words. Texts of any length are read whole. Of
    occurrences of equal distance the first counts. Rows that repeat an id are compared each; a null
    id stays null. Other columns of either table are ignored. An empty table on either side gives none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [slim.mapInArrow(_match(block, error_rate), MATCHES) for block in _blocks(items, min_words)])


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, as they are, null and empty texts too. See :func:`matches` for what occurs.

    The blocks of items stand one behind the other in one pass over the documents.
    """

    def unmatched(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        return run

    for block in _blocks(items, min_words):
        docs = docs.mapInArrow(unmatched(block), docs.schema)
    return docs


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's rows: all of :func:`matches`, which see for nulls, ties, repeats and empty tables."""
    return matches(docs, items)
