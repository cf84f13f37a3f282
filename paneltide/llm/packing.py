"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

Lengths are whole numbers from 1 to the capacity, so a packing is planned on their histogram (one
number for each length, whatever the size of the corpus) and then dealt out to the documents:

1. One pass over the texts tokenises and cuts them. Each piece gets its place among the pieces of
   equal length of its own partition. The pieces (no text) are written to the shared folder.
2. The histogram, at most ``capacity`` rows, goes to the driver, which plans bins of equal content
   with their number of repeats: fill greedily with the longest piece that fits; then put two
   unpacked pieces in place of the bin's smallest one if they fill the gap more tightly.
3. Counts by (partition, length) give each piece its place among all pieces of its length by a
   running sum, and the plan maps that place to a sequence and an offset.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.llm import common

CAPACITY = 1024
END_ID = 2
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Fixed value: what the split's ``\\s`` matches. A run of so many is cut out before the split, whose matcher would recurse along it.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile(f"[{BLANKS}]{{1000,}}")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: itself where it is visible, else the next letter from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(vocabulary: str):
    """Text to ids, equal to those of the ``tokenizers`` file ``vocabulary``, several times faster.

    The file's tokens, their order and its special tokens are read from it; as there, a special token's string in a text is
    that token. Only plain byte-level files are taken.
    """
    import tiktoken

    spec = json.loads(Path(vocabulary).read_text())
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
        raise ValueError(f"not a plain byte-level vocabulary: {vocabulary}")
    letters = _byte_of_letter()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    between = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for run in LONG_BLANK.finditer(text):
            # A run before a word is one piece but for its last character, which goes with the word; a run at the end is one piece.
            cut = run.end() - (run.end() < len(text))
            ids += own.encode_ordinary(text[at : run.start()]) + own.encode_ordinary(text[run.start() : cut])
            at = cut
        return ids + own.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if between is None or not any(t in text for t in special):
            return plain(text)
        ids: list[int] = []
        for i, part in enumerate(between.split(text)):
            ids += [special[part]] if i % 2 else plain(part)
        return ids

    return encode


def _cut(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
        schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array(encode(text or "") + [END_ID], "<u4")
                    n = len(ids)
                    a, piece = 0, 0
                    b = n % capacity or capacity
                    while a < n:
                        length = b - a
                        rows.append((doc, piece, a, length, zlib.crc32(ids[a:b].tobytes()), part, int(seen[length])))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                        seen[length] += 1
                        a, b, piece = b, b + capacity, piece + 1
                columns = dict(zip((f[0] for f in fields), zip(*rows)))
                yield common.record(schema, **columns, **({"ids": kept} if with_ids else {}))

    return run


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, number of such bins) for ``counts[length]`` pieces of each length.

    A bin is repeated as often as its pieces last, so the work depends on how many lengths there
    are and not on how many pieces.
    """
    left = np.array(counts, np.int64)
    left[0] = 0
    plan: list[tuple[list[int], int]] = []
    while left.any():
        rem, gap, chosen = left.copy(), capacity, []
        while gap and (fits := np.flatnonzero(rem[1 : gap + 1])).size:
            longest = int(fits[-1]) + 1
            take = min(gap // longest, int(rem[longest]))
            chosen += [longest] * take
            rem[longest] -= take
            gap -= take * longest
        if gap:
            small = chosen[-1]
            pair = _two_for(rem, gap + small, small)
            if pair:
                chosen[-1:] = pair
        use = np.bincount(chosen, minlength=capacity + 1)
        repeats = int((left[use > 0] // use[use > 0]).min())
        plan.append((chosen, repeats))
        left -= use * repeats
    return plan


def _two_for(rem: np.ndarray, room: int, small: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum over ``small`` and up to ``room``."""
    first = np.flatnonzero(rem[:room])
    if not first.size:
        return None
    there = np.maximum.accumulate(np.where(rem[: room + 1] > 0, np.arange(len(rem[: room + 1])), 0))
    upto = np.minimum(room - first, np.where(rem[first] > 1, first, first - 1))
    second = there[upto]
    total = np.where(second > 0, first + second, 0)
    best = int(np.argmax(total))
    return [int(first[best]), int(second[best])] if total[best] > small else None


def _places(plan: list[tuple[list[int], int]], capacity: int) -> tuple[dict, int]:
    """For each length, where the places of each kind begin: (first rank, first sequence, offset), and the number of sequences."""
    out: dict[int, list] = {}
    ranks = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, repeats in plan:
        at = 0
        for length in lengths:
            out.setdefault(length, []).append((int(ranks[length]), sequence, at))
            ranks[length] += repeats
            at += length
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in out.items()}, sequence


def _place(places: dict, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, kinds = length == n, places[int(n)]
                k = np.searchsorted(kinds[:, 0], rank[rows], "right") - 1
                sequence[rows] = kinds[k, 1] + rank[rows] - kinds[k, 0]
                offset[rows] = kinds[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(sequence), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` if asked).

    Needs doc_id and text; other columns are ignored. A null or empty text is its end token alone.
    Only documents of more than ``capacity`` tokens are cut: the first piece takes the remainder.
    Rows that repeat a doc_id are packed each; a null doc_id stays null. An empty table gives none.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = _PIECES + ", ids array<int>" * with_ids
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = common.written(slim.mapInArrow(_cut(vocabulary, capacity, with_ids), schema), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    places, _ = _places(best_two_fit(histogram, capacity), capacity)
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*fields, "rank").mapInArrow(_place(places, fields), out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, of a packing made ``with_ids``. A group has one capacity of tokens at most."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("doc_ids"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: all of :func:`pack`, which see for nulls, long texts, repeats and empty tables. Pieces of equal length
    may take each other's places; any such packing is as good."""
    return pack(docs)
