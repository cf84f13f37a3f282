"""What the corpus operators share: reading, scratch tables, row keys and vectorised word hashing."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Executors need no copy of this package: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules["paneltide"])

#: ASCII white space, the only characters that separate words here.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text handled at once by the vectorised code; a longer text is handled alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """64-bit hash of a row's id and text. Tables are joined by the id and this hash together (:func:`same_row`), so only
    rows that share an id could ever be confused. Rows that agree in both are handled alike and share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def same_row(left: DataFrame, right: DataFrame, doc: str = "doc", uid: str = "uid") -> Column:
    """Join condition: the same document id (null equals null) and the same row hash."""
    return (left[uid] == right[uid]) & left[doc].eqNullSafe(right[doc])


# -- scratch tables in the shared folder ------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for tables that are read twice")
    if spark not in _own:
        _own[spark] = "file://" + tempfile.mkdtemp(prefix="paneltide-")
    return _own[spark]


_own: dict[SparkSession, str] = {}


def written(df: DataFrame, name: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, has known statistics.

    The tables ``instead_of`` are used up by then and deleted; what is left goes when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/paneltide/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for used in instead_of:
        release(used)
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that :func:`written` gave; nothing may read it any more."""
    _drop(df.sparkSession, df._scratch)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- Arrow batches ----------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cut a batch so that each part holds at most ``most`` bytes of ``column``, or one row."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more offset than rows); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


#: Bytes of one text that are split into words at once.
STRETCH = 1 << 20


def byte_words(raw: bytes, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a stretch of the text at a time; cuts are made at spaces only."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + stretch)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


_BLANK = re.compile(rb"[ \t-\r]")


# -- hashing ----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Finds and hashes white-space separated words of many texts at once.

    A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums, so any
    byte range of the texts can be hashed in constant time.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, min(2 * n, SLICE_BYTES + 1))
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the index of its first word (one more entry than texts)."""
        n = len(raw)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~self.space[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        return starts, ends, np.searchsorted(starts, off)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def hashed(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((prefix[b] - prefix[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each text the index of its first word."""
        raw, off = utf8(texts)
        a, b, first = self.spans(raw, off)
        return self.hashed(self.prefix(raw), a, b), first


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text, and the text it is in. A text of 1 to k-1 words has one run, of all its words."""
    n = np.diff(first)
    long = n >= k
    total = len(words)
    acc = np.zeros(total, np.uint64)
    for j in range(k):
        part = np.zeros(total, np.uint64)
        if j < total:
            part[: total - j] = words[j:]
        acc += part * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(total) - np.repeat(first[:-1], n)
    full = (pos + k <= np.repeat(n, n)) & np.repeat(long, n) if total else np.zeros(0, bool)
    h, d = mix(acc[full]), doc[full]
    short = np.flatnonzero((n > 0) & ~long)
    if len(short):
        extra = np.array([_fold(words[first[i] : first[i + 1]]) for i in short], np.uint64)
        h, d = np.r_[h, extra], np.r_[d, short]
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def _fold(words: np.ndarray) -> int:
    acc = len(words)
    for w in words.tolist():
        acc = (acc * 0xC2B2AE3D27D4EB4F + w) & (2**64 - 1)
    return acc
