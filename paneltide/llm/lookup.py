"""Joins and ranks that hold under hot keys: values by key for many rows, and global ranks without one sorting task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.llm import common

#: A key that more than one row in so many holds is hot: there are fewer hot keys than this, whatever the size.
HOT = 1024


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], held: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row for each key, ``held`` counts its rows among ``total``), null where unknown.

    Rows of hot keys meet their values by broadcast (fewer than 1024 rows); rows with a null key meet none and are not
    shuffled; all other rows meet theirs in a sort-merge join, in which no key has more than one row in 1024.
    """
    names = [c for c in values.columns if c not in keys and c != held]
    hot = values.filter(F.col(held) * HOT > F.lit(total)).select(*keys, F.lit(True).alias("_hot"), *names)
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    marked = rows.join(F.broadcast(hot), keys, "left")
    aside = marked.filter(unknown | F.coalesce("_hot", F.lit(False))).drop("_hot")
    rest = marked.filter(~unknown & F.col("_hot").isNull()).select(*rows.columns)
    return aside.unionByName(rest.join(values.select(*keys, *names).hint("merge"), keys, "left"))


def _numbered(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1, dtype=np.int64))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "_part", "_nth"])

    return run


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (1, 2, 3...) in ``order``: sorted by range partitions, whose sizes are then summed up.

    ``order`` should tell rows apart (repeats of one row may else fill a partition). One row for each partition is sent on.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.written(dealt.mapInArrow(_numbered(rows.columns), kinds + ", _part int, _nth long"), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_nth")).alias(name))
