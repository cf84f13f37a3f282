"""Dominance counting: how many rows lie above each row in two orders, by tiles of two-dimensional running sums.

1. Rows collapse to distinct (slot, level) cells with their counts and weights.
2. The plane is cut into tiles of 8 slots by 16 levels, whatever the data: a tile has 128 cells at most. Within tiles,
   two running sums (numpy, many tiles at once) count the cells at earlier or equal slots and at higher levels.
3. What lies outside a tile comes in over its edges. The *carry column* has, for each level of the tile, what earlier
   blocks of slots hold above it in the same block of levels; the *carry row* has, for each slot, what higher blocks of
   levels hold up to it. Each is the same task on cells that are coarser by a block in one direction (8 slots or 16
   levels together), so it is solved by the same step, until one block is left. Carries are made for the slots and
   levels that a tile has, so they are never more than the cells.
4. The cells' counts are joined back to the rows; cells that many rows share are joined by broadcast.

No step brings more than a tile and its edges together, and nothing but the plane's four bounds goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm import common, lookup

#: A tile is 2**SLOT_BITS slots by 2**LEVEL_BITS levels.
SLOT_BITS, LEVEL_BITS = 3, 4
#: Tiles that are summed at once.
AT_ONCE = 256

_CELL, _DOWN, _ACROSS = 0, 1, 2
_OUT = pa.schema([(c, pa.int64()) for c in ("s", "l", "n", "w", "an", "aw")])


def _sums(strict: bool):
    """Rows (ts, tl, kind, s, l, n, w) sorted by tile to (s, l, n, w, an, aw) of the cells: counts and weights above each."""
    width, height = 1 << SLOT_BITS, 1 << LEVEL_BITS

    def above(rows: np.ndarray, tile: np.ndarray) -> np.ndarray:
        kind, s, l = rows[2], rows[3] & (width - 1), rows[4] & (height - 1)  # noqa: E741
        cell, down, across = (np.flatnonzero(kind == k) for k in (_CELL, _DOWN, _ACROSS))
        out = []
        for values in (rows[5], rows[6]):
            plane = np.zeros((tile[-1] + 1, width, height), np.int64)
            plane[tile[cell], s[cell], l[cell]] = values[cell]
            left = plane.cumsum(1)
            if strict:
                left -= plane
            up = left.sum(2, keepdims=True) - left.cumsum(2)
            column = np.zeros((tile[-1] + 1, height), np.int64)
            column[tile[down], l[down]] = values[down]
            row = np.zeros((tile[-1] + 1, width), np.int64)
            row[tile[across], s[across]] = values[across]
            out.append((up + column[:, None, :] + row[:, :, None])[tile[cell], s[cell], l[cell]])
        return np.stack([*(rows[i][cell] for i in (3, 4, 5, 6)), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
            first = np.r_[np.flatnonzero(new), rows.shape[1]]
            for a in range(0, len(first) - 1, AT_ONCE):
                cut = slice(first[a], first[min(a + AT_ONCE, len(first) - 1)])
                done = above(rows[:, cut], np.cumsum(new[cut]) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], schema=_OUT)

        held = np.zeros((7, 0), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], 1)
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            whole = int(np.argmax(same))  # the last tile may go on in the next batch
            if whole:
                yield from told(rows[:, :whole])
            held = rows[:, whole:]
        if held.shape[1]:
            yield from told(held)

    return run


def _rows(of: DataFrame, kind: int, ts: Column, tl: Column, n: str = "n", w: str = "w") -> DataFrame:
    return of.select(ts.alias("ts"), tl.alias("tl"), F.lit(kind).cast("long").alias("kind"), "s", "l", F.col(n).alias("n"), F.col(w).alias("w"))


def _coarser(cells: DataFrame, **by: Column) -> DataFrame:
    keys = [by.get(c, F.col(c)).alias(c) for c in ("s", "l")]
    return common.written(cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "cells")


def above(cells: DataFrame, slots: tuple[int, int], levels: tuple[int, int], strict: bool = False, across: bool = True) -> DataFrame:
    """(s, l, n, w, an, aw) of distinct cells (s, l, n, w), all long: sums of n and w over the cells at higher levels and at
    earlier slots (with ``strict``) or earlier and equal ones. ``slots`` and ``levels`` bound the coordinates, none below 0.

    Without ``across`` only cells of the same block of levels count. An empty table gives none.
    """
    s, l = F.shiftright("s", SLOT_BITS), F.shiftright("l", LEVEL_BITS)  # noqa: E741
    block = lambda bounds, bits: (bounds[0] >> bits, bounds[1] >> bits)
    wide, high = block(slots, SLOT_BITS), block(levels, LEVEL_BITS)
    rows = _rows(cells, _CELL, s, l)
    if wide[0] < wide[1]:
        down = above(_coarser(cells, s=s), wide, levels, strict=True, across=False)
        rows = rows.unionByName(_rows(down, _DOWN, F.col("s"), l, "an", "aw"))
    if across and high[0] < high[1]:
        over = above(_coarser(cells, l=l), slots, high, strict=strict)
        rows = rows.unionByName(_rows(over, _ACROSS, s, F.col("l"), "an", "aw"))
    dealt = rows.repartitionByRange("ts", "tl").sortWithinPartitions("ts", "tl")  # by range, so that tiles are dealt out evenly
    return dealt.mapInArrow(_sums(strict), "s long, l long, n long, w long, an long, aw long")


def counted(rows: DataFrame, slot: str, level: str, weight: str) -> DataFrame:
    """``rows`` with ``n_above`` and ``w_above``: how many rows are above each (slot not later, level higher), and their weights' sum.

    ``slot``, ``level`` and ``weight`` name long columns; a null weight counts as 0. A row with a null slot or level is above
    none and has null counts. Equal rows count one by one and are not above each other. An empty table gives none.
    """
    used = rows.filter(F.col(slot).isNotNull() & F.col(level).isNotNull())
    cells = used.groupBy(F.col(slot).cast("long").alias("s"), F.col(level).cast("long").alias("l"))
    cells = common.written(cells.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("w")), "cells")
    low = cells.agg(F.min("s"), F.max("s"), F.min("l"), F.max("l"), F.sum("n")).first()
    total = low[4] or 0
    s0, s1, l0, l1 = (x or 0 for x in low[:4])
    moved = cells.select((F.col("s") - s0).alias("s"), (F.col("l") - l0).alias("l"), "n", "w")
    found = above(moved, (0, s1 - s0), (0, l1 - l0)).select((F.col("s") + s0).alias("s"), (F.col("l") + l0).alias("l"), "n", F.col("an").alias("n_above"), F.col("aw").alias("w_above"))
    found = common.written(found, "above")
    keyed = rows.select(F.struct("*").alias("row"), F.col(slot).cast("long").alias("s"), F.col(level).cast("long").alias("l"))
    out = lookup.looked_up(keyed, found, ["s", "l"], "n", total)
    return out.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "n_above", "w_above")


def hour(df: DataFrame, name: str) -> Column:
    """Whole hours since 1970 of a timestamp column taken as UTC, in any session zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return (F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(name)).cast("long")
    return F.floor(F.unix_seconds(name) / 3600).cast("long")


def digest(sales: DataFrame) -> DataFrame:
    """The query's rows (sale_id, slot, level, n_sales, n_rows), one for each row of ``sales``.

    A null time or total, or a total that is not a finite number, has no slot or level: null counts, and above none. Rows
    that repeat a sale_id are sales of their own; a null sale_id stands for one row. Ties are not above each other. An empty
    table gives none; other columns are ignored.
    """
    total = F.col("total").cast("double")
    finite = total.isNotNull() & ~F.isnan(total) & (F.abs(total) < 1e15)
    level = F.when(finite, F.floor(F.floor(total * 100 + 0.5).cast("double") / 100)).cast("long")
    stands = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))).bitwiseAND(F.lit(1))
    slim = sales.select("sale_id", hour(sales, "sold_at").alias("slot"), level.alias("level"), stands.cast("long").alias("_stands"))
    out = counted(slim, "slot", "level", "_stands")
    return out.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))
