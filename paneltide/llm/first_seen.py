"""Stream hashes in order and report every occurrence but the first, however hot a hash is.

Rows are range-partitioned by (hash, document) and sorted inside partitions. The ranges include
the document, so a hash that a third of all documents hold is cut over many partitions. Each
partition is streamed once in bounded memory. Only its first and its last hash can go on in a
neighbour: those rows stay undecided, with one summary row each, and the summaries (two at most
for each partition, at any size of the input) are added up to decide them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common

#: Rows of the stream: row key, document, place, a number of the caller's, two parts of a hash.
ROWS = "uid long, doc long, pos int, n int, h1 long, h2 long"
ROW_SCHEMA = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
_DROP, _OPEN, _SUMMARY = 0, 1, 2


class _Stream:
    """One partition, batch by batch. Memory: one batch, and the rows of fewer than ``least`` units of the hash at hand.

    A unit is a document, or (``by_place``) one place of one row.
    """

    schema = pa.schema([*ROW_SCHEMA, ("units", pa.int64()), ("kind", pa.int32())])
    columns = ("uid", "doc", "null", "pos", "n", "h1", "h2")

    def __init__(self, least: int, by_place: bool) -> None:
        self.least, self.by_place = least, by_place
        self.hash = self.top = self.last = None
        self.units = 0
        self.edge = True  # still in the partition's first run, which may have begun in the one before
        self.held: list[dict] = []

    def out(self, rows: dict, kind: int) -> pa.RecordBatch:
        k = len(rows["uid"])
        return common.record(self.schema, **{c: rows[c] for c in ("uid", "pos", "n", "h1", "h2")}, doc=pa.array(rows["doc"], mask=rows["null"]), units=np.zeros(k, np.int64), kind=np.full(k, kind, np.int32))

    def summary(self) -> pa.RecordBatch:
        doc, uid, pos = self.top
        return common.record(self.schema, uid=[uid], doc=[doc], pos=[pos], n=[0], h1=[self.hash[0]], h2=[self.hash[1]], units=[self.units], kind=[_SUMMARY])

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc = batch.column("doc")
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns if c not in ("doc", "null")}
        rows["null"] = doc.is_null().to_numpy(zero_copy_only=False)
        rows["doc"] = doc.fill_null(0).to_numpy(zero_copy_only=False)
        h1, h2, ids, null, uid, pos = (rows[c] for c in ("h1", "h2", "doc", "null", "uid", "pos"))
        full = lambda i: (None if null[i] else int(ids[i]), int(uid[i]), int(pos[i]))
        unit = full if self.by_place else lambda i: full(i)[0]
        goes_on = self.hash == (h1[0], h2[0])
        new = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        other = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        if self.by_place:
            other |= (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1])
        fresh = new | np.r_[not goes_on or unit(0) != self.last, other]
        begins = np.unique(np.r_[0, np.flatnonzero(new)])
        length = np.diff(np.r_[begins, len(new)])
        before = np.cumsum(fresh) - fresh
        nth = np.cumsum(fresh) - np.repeat(before[begins], length)  # the row's unit within its hash
        if goes_on:
            nth[: length[0]] += self.units
        total = np.repeat(nth[begins + length - 1], length)
        drop, hold = (nth > 1) & (total >= self.least), (nth > 1) & (total < self.least)
        hold[: begins[-1]] = False  # a hash that has ended with too few stays everywhere
        for i in dict.fromkeys((0, min(1, len(begins) - 1), len(begins) - 1)):
            a, n = int(begins[i]), int(length[i])
            if i == 0 and goes_on:
                if self.edge:
                    drop[:n] = hold[:n] = False
                    yield self.out({c: v[:n] for c, v in rows.items()}, _OPEN)
                elif total[0] >= self.least:
                    yield from (self.out(r, _DROP) for r in self.held)
                    self.held = []
                self.units, self.last = int(nth[n - 1]), unit(n - 1)
                continue
            if self.edge and self.hash is not None:
                yield self.summary()
                self.edge = False
            self.held = []
            first = self.hash is None
            self.hash, self.top, self.last, self.units = (h1[a], h2[a]), full(a), unit(a + n - 1), int(nth[a + n - 1])
            if first:
                drop[:n] = hold[:n] = False
                yield self.out({c: v[:n] for c, v in rows.items()}, _OPEN)
        if drop.any():
            yield self.out({c: v[drop] for c, v in rows.items()}, _DROP)
        if hold.any():
            self.held.append({c: v[hold] for c, v in rows.items()})

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.hash is not None:
            yield from (self.out(r, _OPEN) for r in self.held)
            yield self.summary()


def _stream(least: int, by_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least, by_place)
        for batch in batches:
            if batch.num_rows:
                yield from stream.feed(batch)
        yield from stream.end()

    return run


def later_occurrences(rows: DataFrame, least: int, by_place: bool = False, largest_first: bool = False) -> DataFrame:
    """(uid, doc, pos, n) of the rows of each hash that are not of its first unit, if it has at least ``least`` units.

    The first is the smallest document (null before all), or the largest with ``largest_first``
    (null after all); with ``by_place`` the smallest (doc, uid, pos).
    """
    parts = common.partitions(rows.sparkSession)
    # Ranges are found by reading the rows once more, so they are written first: texts are hashed once only.
    rows = common.written(rows, "rows")
    order = [F.col("h1"), F.col("h2"), F.desc_nulls_last("doc") if largest_first else F.asc_nulls_first("doc")]
    order += [F.col("uid")] if by_place else []
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, *[F.col(c) for c in ("uid", "pos")][by_place:])
    schema = ROWS + ", units long, kind int"
    seen = common.written(dealt.mapInArrow(_stream(least, by_place), schema), "stream", [rows])
    top = F.struct("doc", "uid", "pos")
    edges = seen.filter(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.sum("units").alias("_units"), (F.max(top) if largest_first else F.min(top)).alias("_top"))
    edges = edges.filter(F.col("_units") >= least)
    same = F.col("doc").eqNullSafe(F.col("_top.doc"))
    if by_place:
        same = same & (F.col("uid") == F.col("_top.uid")) & (F.col("pos") == F.col("_top.pos"))
    cols = ["uid", "doc", "pos", "n"]
    # Every row passes one broadcast join against the few summaries; decided rows pass as they are.
    rows = seen.filter(F.col("kind") != _SUMMARY).join(F.broadcast(edges), ["h1", "h2"], "left")
    return rows.filter((F.col("kind") == _DROP) | (F.col("_units").isNotNull() & ~same)).select(*cols)
