"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

1. A text's shingles are its distinct runs of five words. Each is a Poisson process of rate equal to its weight whose
   arrivals fall on random registers; a register keeps the shingle of its earliest arrival. A shingle stops as soon as its
   next arrival is later than every register's (early termination), so most of them arrive a few times only. Two
   signatures agree in a register with the texts' probability Jaccard similarity. Here all shingles of a text weigh the
   same: their probability Jaccard is then the Jaccard similarity of the shingle sets, which decides. (With weights by
   count a signature would estimate another similarity than the one that decides, and links would be lost.)
2. Texts with equal shingle sets become one node, named by 128 bits. Nodes that agree in a band of registers meet in a
   bucket. Each is first compared with its bucket's hub, the member that meets most others (in a group of edited copies
   that is the text they were made from); the exact Jaccard similarity of the shingle sets decides.
3. Connected components are found by star contraction on tables in the shared folder.
4. Buckets that still hold several components are searched again. In buckets of at most 64 nodes, every member outside
   the largest component meets all members of other components; pairs whose 256 registers agree five standard errors
   worse than the threshold are left out, which hits a pair at the threshold with probability 3e-7. The nodes of larger
   buckets are joined exactly by prefix filter: shingles in order of how many of these nodes hold them, and two sets of
   sufficient similarity must have one in common among their rarest. Texts that share a template but are not similar
   enough have only frequent shingles in common, so they do not meet, however many they are.

Groups of copies are thus never expanded into all their pairs, and of the pairs that share a band only those of point 4's
five standard errors go unverified. Two texts of similarity 0.8 share a band with probability 1 - (1 - 0.8**4)**20 = 0.99997.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm import common

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Nodes of a bucket whose pairs are tested one by one; larger buckets are joined by prefix filter.
SMALL_BUCKET = 64

#: Slots of the table that counts how many nodes of crowded buckets hold a shingle; a power of two, the same at any size.
SLOTS = 1 << 17
#: Slots whose counts make one row.
BLOCK = 1 << 10
#: Registers of a signature. Bands use the first ones; all of them estimate similarity before a pair is verified.
REGISTERS = 256

_GOLDEN = 0x9E3779B97F4A7C15


def shingles(texts: pa.Array, words: common.Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct k-word shingles of lower-cased texts, in order of text and hash."""
    hashed, first = words.words(pc.utf8_lower(texts))
    h, d = common.windows(hashed, first, k)
    if not len(h):
        return d, h, np.zeros(0, np.int64)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return d[new], h[new], np.diff(np.r_[new, len(h)])


def signatures(d: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs x registers) of weighted shingles ``h`` of documents ``d``."""
    time = np.full(n_docs * registers, np.inf)
    holder = np.zeros(n_docs * registers, np.uint64)
    alive = np.arange(len(h))
    clock = np.zeros(len(h))
    step = 0
    while alive.size:
        block = int(min(64, max(1, 65536 // alive.size)))
        seeds = h[alive][:, None] + (np.arange(step + 1, step + block + 1, dtype=np.uint64) * np.uint64(_GOLDEN))[None, :]
        bits = common.mix(seeds)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[alive][:, None]
        at = clock[alive][:, None] + np.cumsum(gaps, axis=1)
        register = (common.mix(bits ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        key = (d[alive] * registers)[:, None] + register
        who = np.broadcast_to(h[alive][:, None], key.shape)
        early = at < time[key]
        key, when, who = key[early], at[early], who[early]
        np.minimum.at(time, key, when)
        won = time[key] == when
        holder[key[won]] = who[won]
        clock[alive] = at[:, -1]
        limit = time.reshape(n_docs, registers).max(axis=1)
        alive = alive[clock[alive] < limit[d[alive]]]
        step += block
    return holder.reshape(n_docs, registers)


_SIGNED = "uid long, doc_id long, node binary, n int, bands array<long>, sketch array<int>"


def _sign(bands: int, rows: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int32()))])
        for whole in batches:
            for big in common.slices(whole, "text"):
                for a in range(0, big.num_rows, 4096):
                    batch = big.slice(a, 4096)
                    docs = batch.num_rows
                    d, h, _ = shingles(batch.column("text"), words)
                    n = np.bincount(d, minlength=docs)
                    set1, set2 = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
                    some = np.flatnonzero(n)
                    if some.size:
                        begins = np.searchsorted(d, some)
                        set1[some] = common.mix(np.add.reduceat(common.mix(h), begins))
                        set2[some] = common.mix(np.add.reduceat(common.mix(h ^ np.uint64(_GOLDEN)), begins))
                    sig = signatures(d, h, np.ones(len(h)), docs, max(registers, bands * rows))
                    low = (common.mix(sig) >> np.uint64(56)).astype(np.uint8)
                    sig = sig[:, : bands * rows].reshape(docs, bands, rows)
                    key = np.zeros((docs, bands), np.uint64)
                    for r in range(rows):
                        key = common.mix(key + sig[:, :, r] + np.uint64(r + 1))
                    key = common.mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                    low = np.ascontiguousarray(np.pad(low, ((0, 0), (0, -low.shape[1] % 4)))).view(np.int32)
                    packed = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * low.shape[1]), pa.array(low.reshape(-1)))
                    both = np.stack([common.mix(set1 + n.astype(np.uint64)), set2], 1).tobytes()
                    node = pa.Array.from_buffers(pa.binary(16), docs, [None, pa.py_buffer(both)])
                    yield common.record(schema, uid=batch.column("uid"), doc_id=batch.column("doc_id"), node=node, n=n, bands=lists, sketch=packed)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = common.Words()
    schema = pa.schema([("node", pa.binary()), ("set", pa.list_(pa.int64()))])
    for whole in batches:
        for batch in common.slices(whole, "text"):
            d, h, _ = shingles(batch.column("text"), words)
            ends = np.searchsorted(d, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield common.record(schema, node=batch.column("node"), set=pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))))


def _alike(a: Column, b: Column, least: float) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _agreeing(a: str, b: str, words: int) -> Column:
    """Number of equal bytes of two sketches of ``words`` 32-bit numbers."""
    total = F.lit(4 * words)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        differs = (x.bitwiseAND(F.lit(0x7F7F7F7F)) + F.lit(0x7F7F7F7F)).bitwiseOR(x).bitwiseAND(F.lit(0x80808080))
        total = total - F.bit_count(differs)
    return total


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``least``."""
    one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.filter(both / (F.size("_a") + F.size("_b") - both) >= F.lit(least)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the component's smallest node.

    Alternating large-star and small-star steps. Each step is an aggregation and a join by node, so
    a node with very many neighbours is summed up before the shuffle and its join can be split.
    """
    now = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = _state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        now = common.written(small.filter("u != v").distinct(), "edges", [now])
        if (then := _state(now)) == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _small_pairs(mixed: DataFrame, nodes: DataFrame, similarity: float, registers: int) -> DataFrame:
    """Pairs (a, b) to verify of buckets of few nodes: (key, node, n, root, main)."""
    full = mixed.join(nodes.select("node", "sketch", "bands"), "node")
    x = full.filter("root != main").select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("sketch").alias("s_a"), F.col("bands").alias("b_a"))
    y = full.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), "main", F.col("sketch").alias("s_b"), F.col("bands").alias("b_b"))
    enough = registers * (similarity - 5 * (similarity * (1 - similarity) / registers) ** 0.5)
    across = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("a") > F.col("b"))) & _alike(F.col("n_a"), F.col("n_b"), similarity)
    across = across & (_agreeing("s_a", "s_b", -(-registers // 4)) - (-registers % 4) >= enough)
    across = across & (F.array_min(F.array_intersect("b_a", "b_b")) == F.col("key"))  # in one of its buckets only
    return x.join(y, "key").filter(across).select("a", "b")


_HELD = pa.schema([("block", pa.int32()), ("slot", pa.list_(pa.int32())), ("held", pa.list_(pa.int64()))])


def _blocks(count: np.ndarray) -> pa.RecordBatch:
    """The slots that are held, and how often, as a row for each block of them."""
    slot = np.flatnonzero(count)
    block, first = np.unique(slot // BLOCK, return_index=True)
    ends = pa.array(np.r_[first, len(slot)].astype(np.int32))
    return common.record(_HELD, block=block, slot=pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))), held=pa.ListArray.from_arrays(ends, pa.array(count[slot])))


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(SLOTS, np.int64)
    for batch in batches:
        count += np.bincount(batch.column("set").flatten().to_numpy(zero_copy_only=False) & (SLOTS - 1), minlength=SLOTS)
    yield _blocks(count)


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(SLOTS, np.int64)
    for batch in batches:
        np.add.at(count, batch.column("slot").flatten().to_numpy(), batch.column("held").flatten().to_numpy())
    yield _blocks(count)


_PREFIX = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("root", pa.binary()), ("place", pa.int32()), ("index", pa.bool_()), ("h", pa.int64())])


def _prefixes(often: Broadcast, similarity: float):
    def first(n: int, share: float) -> int:
        return n - math.ceil(round(share * n, 6)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = often.value
        for batch in batches:
            sets = batch.column("set")
            for i in range(batch.num_rows):
                h = sets[i].values.to_numpy(zero_copy_only=False)
                n = len(h)
                chosen = h[np.lexsort((h, held[h & (SLOTS - 1)]))[: first(n, similarity)]]
                place = np.arange(1, len(chosen) + 1)
                same = {c: pa.repeat(batch.column(c)[i], len(chosen)) for c in ("node", "root")}
                yield common.record(_PREFIX, **same, n=np.full(len(chosen), n), place=place, index=place <= first(n, 2 * similarity / (1 + similarity)), h=chosen)

    return run


def _prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root) that have different roots and can reach the similarity.

    Shingles are put in order of how many of the nodes hold them. Of two sets that reach similarity s, the smaller one's
    first n - ceil(2s / (1 + s) n) + 1 shingles and the larger one's first n - ceil(s n) + 1 have one in common. That holds
    for any one order, so holders are counted in a table of fixed size, by the shingle's last bits, which is broadcast.
    """
    held = sets.join(members, "node").select("node", "root", "set")
    kinds = "block int, slot array<int>, held array<long>"
    slots = held.select("set").mapInArrow(_slot_counts, kinds).repartition("block").mapInArrow(_slot_sums, kinds).toArrow()
    often = np.zeros(SLOTS, np.int64)
    for part in slots.to_batches():
        np.add.at(often, part.column("slot").flatten().to_numpy(), part.column("held").flatten().to_numpy())
    del slots
    often = sets.sparkSession.sparkContext.broadcast(often)
    kinds = "node binary, n int, root binary, place int, index boolean, h long"
    ranked = common.written(held.mapInArrow(_prefixes(often, similarity), kinds), "prefixes")
    side = lambda rows, p: rows.select("h", *[F.col(c).alias(f"{c}_{p}") for c in ("node", "n", "root", "place")])
    x, y = side(ranked.filter("index"), "a"), side(ranked, "b")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    left = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    can = left >= F.round(F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")), 6)
    found = x.join(y, "h").filter(smaller & (F.col("root_a") != F.col("root_b")) & _alike(F.col("n_a"), F.col("n_b"), similarity) & can)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, doc_id, class_id, class_key, n_shingles), one row for each row of ``docs``; class_id is the class's smallest
    doc_id. Where rows repeat a doc_id, two classes may have the same; class_key tells them apart.

    Needs doc_id and text; other columns are ignored. Words are lower-cased and separated by ASCII
    white space; a text of one to four words has one shingle, all of it. Texts without a word (null
    or empty) are copies of each other. Repeated rows are copies. A class whose ids are all null
    has a null class_id. An empty table gives none.
    """
    slim = docs.select(common.row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.written(slim.mapInArrow(_sign(bands, rows, REGISTERS), _SIGNED), "signed")
    nodes = signed.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "uid")).alias("at"), F.min(F.struct("bands", "sketch")).alias("b"))
    nodes = common.written(nodes.select("node", "n", "doc_id", "at", "b.bands", "b.sketch"), "nodes")
    member = nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    crowd = common.written(member.join(sizes, "key"), "crowd")
    popular = crowd.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = crowd.join(popular, "node").groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("hub"))

    first = crowd.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & _alike(F.col("n"), F.col("hub.n"), similarity))
    first = common.written(first.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "pairs")
    wanted = nodes.join(crowd.select("node").distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("doc"), F.col("at.uid").alias("uid"))
    rows_of = slim.withColumnRenamed("doc_id", "doc")
    texts = rows_of.join(wanted, common.same_row(rows_of, wanted)).select("node", "text")
    sets = common.written(texts.mapInArrow(_sets, "node binary, set array<long>").dropDuplicates(["node"]), "sets")
    links = common.written(_verified(first, sets, similarity), "links")
    found = common.written(components(links), "components")

    placed = crowd.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    tally = placed.groupBy("key", "root").count()
    split = tally.groupBy("key").agg(F.count("*").alias("parts"), F.sum("count").alias("size"), F.max(F.struct("count", "root")).alias("most")).filter("parts > 1")
    mixed = common.written(placed.join(split.select("key", "size", F.col("most.root").alias("main")), "key"), "mixed", [crowd])
    few = _small_pairs(mixed.filter(F.col("size") <= SMALL_BUCKET), nodes, similarity, max(REGISTERS, bands * rows))
    many = _prefix_pairs(mixed.filter(F.col("size") > SMALL_BUCKET).select("node", "root").distinct(), sets, similarity)
    rest = few.unionByName(many).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written before it is verified: in one plan, all stages of both searches would be open at once on the driver.
    rest = common.written(rest.join(tried, ["a", "b"], "left_anti"), "pairs", [links, mixed, first])
    more = common.written(_verified(rest, sets, similarity), "links", [rest, sets])
    if not more.isEmpty():
        found = common.written(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "components", [found, more])

    rooted = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = rooted.join(names, "root").select("node", "root", "class_id")
    return signed.join(named, "node").select("uid", "doc_id", "class_id", F.col("root").alias("class_key"), F.col("n").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: of the smallest doc_id (null before all), then of the smallest row key.

    Of rows that agree in id and text, one stays.
    """
    rows = common.written(classes(docs, similarity), "classes")
    best = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "uid")).alias("k"))
    chosen = common.written(best.select(F.col("k.doc_id").alias("doc"), F.col("k.uid").alias("uid")), "chosen")
    held = rows.select("uid", F.col("doc_id").alias("doc"))
    times = held.join(chosen, common.same_row(held, chosen), "left_semi").groupBy("doc", "uid").agg((F.count("*") > 1).alias("_again"))
    times = common.written(times, "chosen", [rows, chosen])
    names = docs.columns
    packed = docs.select(common.row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc"), F.struct("*").alias("row"))
    packed = packed.join(times, common.same_row(packed, times)).select(times["doc"], times["uid"], "row", "_again")
    once = packed.filter(~F.col("_again")).select("row")
    again = packed.filter("_again").groupBy("doc", "uid").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select(*[F.col("row").getField(n).alias(n) for n in names])


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows (doc_id, class_id, n_shingles), one for each row of ``docs``: null and empty texts are one class of their
    own, very long texts are read whole, ties and repeated rows share a class, an empty table gives none, other columns are ignored."""
    return classes(docs).select("doc_id", "class_id", "n_shingles")
