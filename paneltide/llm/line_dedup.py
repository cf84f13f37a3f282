"""Line dedup: range-partitioned line hashes, streamed in order, kept as per-document bitmaps.

1. Every line's key is hashed to 128 bits next to the scan; only (hash, document, place) go on.
2. The rows are range-partitioned by (hash, document) and sorted within partitions by place, with
   the largest document first. The ranges include the document, so a line that a third of all
   documents hold is cut over many partitions instead of meeting in one task.
3. Each partition is streamed once (:mod:`first_seen`). The first document of a hash keeps its
   lines; the later ones lose theirs once enough documents have been seen.
4. What is dropped is packed into a compressed keep bitmap for each document, and no text moves
   until the bitmaps are applied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common, first_seen


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                which, place, total, digests = [], [], [], []
                for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                    if not text or len(text) < min_chars:
                        continue
                    lines = text.split(b"\n")
                    n = len(lines)
                    for i, line in enumerate(lines):
                        key = line.strip(b" \t\n\r\x0b\x0c").lower()
                        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                            continue
                        which.append(row)
                        place.append(i)
                        total.append(n)
                        digests.append(xxhash.xxh3_128_digest(key))
                if which:
                    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    take = pa.array(which, pa.int32())
                    yield common.record(first_seen.ROW_SCHEMA, uid=batch.column("uid").take(take), doc=batch.column("doc").take(take), pos=place, n=total, h1=h[:, 0].copy(), h2=h[:, 1].copy())

    return run


def line_rows(docs: DataFrame, min_chars: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(uid, doc, pos, n, h1, h2) of each line whose key has at least ``min_chars`` code points."""
    slim = docs.select(common.row_key(text, doc_id).alias("uid"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return slim.mapInArrow(_line_rows(min_chars), first_seen.ROWS)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("n_lines", pa.int32()), ("keep", pa.binary())])
    for batch in batches:
        packed = []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist()):
            bits = np.ones(n, bool)
            bits[drops] = False
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield common.record(schema, uid=batch.column("uid"), doc=batch.column("doc"), n_lines=batch.column("n_lines"), keep=packed)


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(uid, doc, n_lines, keep): the compressed keep bitmap of each document that loses a line.

    ``uid`` is :func:`common.row_key`; ``doc`` and ``uid`` together name the row. A document is a doc_id: rows that repeat an id count once,
    and all of them keep a line that the largest id holds. A null id is smaller than any other.
    Documents without a bitmap keep all their lines.
    """
    lines = line_rows(docs, min_chars, text, doc_id)
    drops = first_seen.later_occurrences(lines, min_docs, largest_first=True)
    by_doc = drops.groupBy("uid", "doc").agg(F.max("n").alias("n_lines"), F.collect_set("pos").alias("drops"))
    return by_doc.mapInArrow(_bitmaps, "uid long, doc long, n_lines int, keep binary")


def _kept(text: str, keep: bytes | None) -> tuple[str, int, int]:
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    return "\n".join([lines[i] for i in np.flatnonzero(bits)]), len(lines), int(len(lines) - bits.sum())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        got = [_kept(t or "", k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist())]
        yield common.record(schema, doc_id=batch.column("doc_id"), n_lines=[g[1] for g in got], n_dropped=[g[2] for g in got], kept_sha256=[hashlib.sha256(g[0].encode()).hexdigest() for g in got])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``keep`` (null: all lines stay)."""
    rows = docs.select(common.row_key(text, doc_id).alias("uid"), F.col(doc_id).cast("long").alias("doc"), F.struct("*").alias("row"))
    return rows.join(bitmaps, common.same_row(rows, bitmaps), "left").select("row", "keep")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of ``text``; every other column, of any name, stays.

    Null and empty texts are one empty line and stay as they are. An empty table stays empty.
    """
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            kept = [t if k is None or t is None else _kept(t, k)[0] for t, k in zip(texts, batch.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "t"])

    names = docs.columns
    flat = joined.select("row", F.col("row.text").alias("t"), "keep")
    rest = F.col("row").dropFields("text") if len(names) > 1 else F.lit(None)
    flat = flat.withColumn("row", rest)
    done = flat.mapInArrow(apply, flat.select("row", "t").schema)
    return done.select(*[F.col("t").alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in names])


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``docs``: a null or empty text is one empty line and drops none; lines that tie
    (one id in several rows) all stay; repeated rows are counted each; an empty table gives none; other columns are ignored."""
    slim = docs.select("doc_id", "text")
    joined = with_bitmaps(slim, keep_bitmaps(slim)).select("row.doc_id", "row.text", "keep")
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
