"""SimHash near duplicates by the generalised pigeonhole principle.

1. A text's fingerprint has 64 bits; each is the majority of that bit in the hashes of its word shingles. Equal
   fingerprints become one node; nodes link where at most two bits differ.
2. *Parts.* Bits that tend to agree are put into one part of the fingerprint, greedily by their correlations, so that a
   part's values are uneven: rare values of one part can be probed widely, frequent ones of another not at all. There are
   three layouts: three parts, two parts, and one part of all bits.
3. *Thresholds.* If two fingerprints differ in at most r bits, and the parts' thresholds t_i (-1 or more) have
   sum(t_i + 1) = r + 1, then in some part i they differ in at most t_i bits. Any such choice finds all links of a
   fingerprint, so each one takes its cheapest: how many nodes a probe meets is estimated from tables of counts of fixed
   size, by part and value, and dynamic programming deals out the r + 1 units over the parts, in each layout. The layout
   of one part costs the 2081 probes of the whole ball however the data are, so no fingerprint ever costs more.
4. *Probe and verify.* Probes meet the nodes in an equi-join by part and value, which then compares all 64 bits. Values
   that so many nodes share that no one can have chosen to probe them are left out of the join, on the same estimate.
5. Connected components of the links give classes; rows get theirs by fingerprint, frequent fingerprints by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common, lookup, near_dedup

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Parts of each layout.
LAYOUTS = (3, 2, 1)
#: Slots of the table of counts of one part; a power of two, the same at any size.
SLOTS = 1 << 16

_BIT = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """64 bits of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of ``k`` words with repeats.

    Fewer words are one shingle; no word gives 0. A text is read a stretch at a time, whatever its length.
    """
    ones, n, last = np.zeros(BITS, np.int64), 0, []
    for words in common.byte_words((text or b"").lower()):
        last += words
        if len(last) >= k:
            joined = b" ".join(last)
            size = np.fromiter(map(len, last), np.int64, len(last))
            begin = np.cumsum(size + 1) - size - 1
            spans = zip(begin[: len(last) - k + 1].tolist(), (begin + size)[k - 1 :].tolist())
            hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(last) - k + 1)
            ones += _ones(hashes)
            n += len(hashes)
            last = last[len(last) - k + 1 :]
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(_BIT[2 * ones > n].sum())


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text").cast(pa.large_binary())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


# -- parts ------------------------------------------------------------------------------------


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS + 1, BITS), np.int64)
    for batch in batches:
        bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for a in range(0, len(bits), 1 << 16):
            both[:BITS] += (bits[a : a + (1 << 16)].T @ bits[a : a + (1 << 16)]).astype(np.int64)
        both[BITS, 0] += len(bits)
    cell = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(both.reshape(-1)[cell])], names=["cell", "n"])


def correlations(nodes: DataFrame) -> np.ndarray:
    """Absolute correlation of each two bits over all nodes (column ``fp``); 64 x 64 numbers go to the driver."""
    both = np.zeros((BITS + 1) * BITS)
    for row in nodes.select("fp").mapInArrow(_agreement, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row["cell"]] = row["n"]
    n = max(1.0, both[BITS * BITS])
    mean = both[: BITS * BITS].reshape(BITS, BITS) / n
    p = mean.diagonal()
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return np.where(spread > 0, np.abs(mean - np.outer(p, p)) / np.where(spread > 0, spread, 1), 0)


def grouped(likeness: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` parts of near equal width: each begins with the free bit that is most like the other free ones and
    takes the free bit most like its own until it is full. Ties go to the lower bit."""
    free, masks = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        inside = likeness[np.ix_(free, free)]
        own = [free.pop(int(inside.sum(1).argmax()))]
        while len(own) < width:
            own.append(free.pop(int(likeness[np.ix_(free, own)].sum(1).argmax())))
        masks.append(sum(1 << b for b in own))
    return masks


# -- estimates and thresholds -------------------------------------------------------------------


def _slot(values: np.ndarray, part: int) -> np.ndarray:
    own = np.uint64((part + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (common.mix(values + own) & np.uint64(SLOTS - 1)).astype(np.int64)


def _tallied(masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(masks), SLOTS), np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, mask in enumerate(masks):
                held[i] += np.bincount(_slot(fp & np.uint64(mask), i), minlength=SLOTS)
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held.reshape(-1)[cell])], names=["cell", "n"])

    return run


def flips(mask: int, errors: int) -> np.ndarray:
    """What to xor a value with for all values that differ in at most ``errors`` bits of ``mask``, itself first."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(c) for e in range(errors + 1) for c in combinations(bits, e)], np.uint64)


@dataclass
class Plan:
    """Parts (masks) of all layouts, what belongs to each layout, and the tables of counts of all parts but the last, of all bits."""

    held: np.ndarray
    masks: list[int]
    layouts: list[list[int]]
    nodes: int
    radius: int = RADIUS

    def __post_init__(self) -> None:
        self.balls = [[flips(m, e) for e in range(self.radius + 1)] for m in self.masks]
        self.most = len(self.balls[-1][-1])  # what the layout of one part costs, so the most that any choice costs

    def met(self, values: np.ndarray, part: int) -> np.ndarray:
        """Estimated number of nodes with these values of a part: the slot's count less what other values bring on average."""
        if part == len(self.masks) - 1:
            return np.zeros(values.shape)
        count = self.held[part][_slot(values, part)]
        return np.maximum(0.0, count - (self.nodes - count) / (SLOTS - 1))

    def cost(self, values: np.ndarray, part: int, errors: int) -> np.ndarray:
        ball = self.balls[part][errors]
        out = np.zeros(len(values))
        for a in range(0, len(values), 1024):
            out[a : a + 1024] = self.met(values[a : a + 1024, None] ^ ball, part).sum(1)
        return out + len(ball)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints x parts) units: a threshold plus one, 0 where a part is not probed; the cheapest of all layouts."""
        units = self.radius + 1
        best, chosen = np.full(len(fp), np.inf), np.zeros((len(fp), len(self.masks)), np.int8)
        for layout in reversed(self.layouts):
            least = np.full((len(fp), units + 1), np.inf)
            least[:, 0] = 0
            taken = []
            for part in layout:
                prices = np.full((len(fp), units + 1), np.inf)
                prices[:, 0] = 0
                for u in range(1, units + 1):
                    worth = np.flatnonzero(best > len(self.balls[part][u - 1]))  # the probes alone may cost too much
                    prices[worth, u] = self.cost(fp[worth] & np.uint64(self.masks[part]), part, u - 1)
                now, via = np.full_like(least, np.inf), np.zeros((len(fp), units + 1), np.int8)
                for t in range(units + 1):
                    options = np.stack([least[:, t - u] + prices[:, u] for u in range(t + 1)], 1)
                    via[:, t] = options.argmin(1)
                    now[:, t] = options.min(1)
                least = now
                taken.append(via)
            better = np.flatnonzero(least[:, units] < best)
            best[better] = least[better, units]
            chosen[better] = 0
            left = np.full(len(better), units)
            for part, via in zip(reversed(layout), reversed(taken)):
                u = via[better, left]
                chosen[better, part] = u
                left = left - u
        return chosen


def make_plan(nodes: DataFrame, radius: int = RADIUS, layouts: tuple[int, ...] = LAYOUTS) -> Plan:
    """Parts and tables of counts from all nodes (column ``fp``). The layout of one part is always there, as the last."""
    likeness = correlations(nodes)
    masks: list[int] = []
    held_by = []
    for parts in [p for p in layouts if p > 1] + [1]:
        held_by.append(list(range(len(masks), len(masks) + parts)))
        masks += grouped(likeness, parts)
    held = np.zeros(((len(masks) - 1) * SLOTS), np.int64)
    counts = nodes.select("fp").mapInArrow(_tallied(masks[:-1]), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    held = held.reshape(len(masks) - 1, SLOTS)
    return Plan(held, masks, held_by, int(held[0].sum()) if len(held) else nodes.count(), radius)


def _probes(shape: tuple, held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(held.value, *shape)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(a, 4096).to_numpy().view(np.uint64)
                units = p.thresholds(fp)
                for part, mask in enumerate(p.masks):
                    for u in range(1, p.radius + 2):
                        who = fp[units[:, part] == u]
                        ball = p.balls[part][u - 1]
                        for b in range(0, len(who), max(1, (1 << 18) // len(ball))):
                            some = who[b : b + max(1, (1 << 18) // len(ball))]
                            values = ((some & np.uint64(mask))[:, None] ^ ball).reshape(-1)
                            q = np.repeat(some, len(ball))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), part, np.int32)), pa.array(values.view(np.int64)), pa.array(q.view(np.int64))], names=["part", "value", "q"])

    return run


def _indexed(shape: tuple, held: Broadcast, used: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(held.value, *shape)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for part in used:
                values = fp & np.uint64(p.masks[part])
                kept = p.met(values, part) <= p.most  # a value that more nodes hold was too dear for every probe
                values, x = values[kept], fp[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(values.view(np.int64)), pa.array(x.view(np.int64))], names=["part", "value", "x"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, layouts: tuple[int, ...] = LAYOUTS) -> DataFrame:
    """(a, b), a > b, of all distinct fingerprints ``fp`` (long) of ``nodes`` that differ in at most ``radius`` bits."""
    plan = make_plan(nodes, radius, layouts)
    shape = plan.masks, plan.layouts, plan.nodes, plan.radius
    held = nodes.sparkSession.sparkContext.broadcast(plan.held)  # of fixed size: five tables of 65,536 numbers
    probes = common.written(nodes.select("fp").mapInArrow(_probes(shape, held), "part int, value long, q long"), "probes")
    used = sorted(r["part"] for r in probes.select("part").distinct().collect())  # at most six
    index = nodes.select("fp").mapInArrow(_indexed(shape, held, used), "part int, value long, x long")
    near = (F.col("x") < F.col("q")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= radius)
    return probes.join(index.hint("merge"), ["part", "value"]).filter(near).select(F.col("q").alias("a"), F.col("x").alias("b")).distinct()


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, n_links), one row for each row of ``docs``: the fingerprint, the smallest doc_id that links
    reach from it, and to how many other fingerprints it links.

    Texts without a word (null, empty) have fingerprint 0 and link like others. Repeated rows have one fingerprint. Null
    doc_ids are passed over for the smallest; if there are no others it is null. An empty table gives none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.written(slim.mapInArrow(_printed, "doc_id long, fp long"), "prints")
    nodes = common.written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    pairs = common.written(links(nodes, radius), "links")
    found = near_dedup.components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    rooted = common.written(rooted.select("fp", "n", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(rooted.join(low, "root").select("fp", "n", "component_id", "n_links"), "named", [rooted])
    return lookup.looked_up(rows, named, ["fp"], "n", rows.count())


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows (doc_id, fingerprint as 16 hex digits, component_id, n_links), one for each row of ``docs``. See
    :func:`classes` for nulls, repeats and empty tables; very long texts are read whole; other columns are ignored."""
    out = classes(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
