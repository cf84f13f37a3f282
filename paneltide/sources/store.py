"""Snapshots as immutable Parquet generations behind a pointer, with fingerprints, migration and run logs."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from paneltide.operators import relational as rel
from paneltide.schema import STORE_KEYS, STORE_TABLES

POINTER = "CURRENT"


class ReadOnlyError(RuntimeError):
    pass


def migrated(df: DataFrame, schema: StructType) -> DataFrame:
    """The table in the schema's columns and types; columns that an older file lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def resolve(root: str) -> str:
    """Folder of the live generation. A pointer that leads out of the root is refused."""
    name = (Path(root) / POINTER).read_text().strip()
    if not name or os.path.isabs(name) or ".." in Path(name).parts:
        raise ValueError(f"pointer {name!r} leads out of {root}")
    return str(Path(root) / name)


def complete(folder: str) -> list[str]:
    """Names of the canonical tables that a folder lacks."""
    return [t for t in STORE_TABLES if not (Path(folder) / f"{t}.parquet").exists()]


class Store:
    """The four canonical tables of one generation. The pointer is resolved once, so a reader sees one state."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = True) -> None:
        self.spark, self.root, self.read_only = spark, root, read_only
        if not (Path(root) / POINTER).exists():
            if read_only:
                raise FileNotFoundError(f"no store at {root}")
            self.publish({t: spark.createDataFrame([], s) for t, s in STORE_TABLES.items()})
        self.folder = resolve(root)
        if missing := complete(self.folder):
            raise FileNotFoundError(f"{self.folder} lacks {', '.join(missing)}")

    def _guard(self, what: str) -> None:
        if self.read_only:
            raise ReadOnlyError(f"{what}: the store is read-only")

    def catalog(self) -> DataFrame:
        """(table, column, type, position) of every table of the generation, canonical or not."""
        found = sorted(p for p in Path(resolve(self.root)).glob("*.parquet"))
        rows = [(p.stem, f.name, f.dataType.simpleString(), n) for p in found for n, f in enumerate(self.spark.read.parquet(str(p)).schema)]
        return self.spark.createDataFrame(rows, "table string, column string, type string, position int")

    def table(self, name: str) -> DataFrame:
        return migrated(self.spark.read.parquet(f"{self.folder}/{name}.parquet"), STORE_TABLES[name])

    def views(self) -> None:
        for t in STORE_TABLES:
            self.table(t).createOrReplaceTempView(t)

    def snapshot_asof(self):
        """Newest modification time of the generation's files."""
        times = [self.spark.read.parquet(f"{self.folder}/{t}.parquet").select(F.max("_metadata.file_modification_time").alias("m")) for t in STORE_TABLES]
        found = [t.first()[0] for t in times]
        return max((x for x in found if x), default=None)

    # -- writes: each makes a new generation and moves the pointer --

    def _with(self, **changed: DataFrame) -> None:
        self.publish({t: changed.get(t) if t in changed else self.table(t) for t in STORE_TABLES})
        self.folder = resolve(self.root)

    def write_fund_master(self, df: DataFrame) -> None:
        """Replaces the snapshot dates present in the input; columns are matched by name."""
        self._guard("write_fund_master")
        self._with(fund_master=rel.replace_partitions(self.table("fund_master"), migrated(df, STORE_TABLES["fund_master"]), "snapshot_date"))

    def write_fund_master_rows(self, df: DataFrame) -> None:
        self._guard("write_fund_master_rows")
        self._upsert("fund_master", df.withColumn("_seq", F.lit(0)))

    def upsert_nav(self, df: DataFrame, arrival: str = "_seq") -> None:
        self._guard("upsert_nav")
        self._upsert("fund_nav", df, arrival)

    def upsert_macro(self, df: DataFrame, arrival: str = "_seq") -> None:
        self._guard("upsert_macro")
        self._upsert("macro", df, arrival)

    def _upsert(self, name: str, df: DataFrame, arrival: str = "_seq") -> None:
        stored = self.table(name)
        new = migrated(df, STORE_TABLES[name]).columns
        arrived = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(STORE_TABLES[name][c].dataType).alias(c) for c in new], F.col(arrival) if arrival in df.columns else F.lit(0).alias(arrival))
        self._with(**{name: rel.upsert(stored, arrived, STORE_KEYS[name], arrival)})

    def log_run(self, run_id: str, kind: str, started, finished, status: str, summary: dict) -> None:
        self._guard("log_run")
        row = self.spark.createDataFrame([(run_id, kind, started, finished, status, json.dumps(summary, sort_keys=True, default=str))], STORE_TABLES["runs"])
        self._with(runs=self.table("runs").unionByName(row))

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Writes a generation, checks each table's count and fingerprint against what was read back, then moves the pointer.

        A failure leaves the pointer where it was.
        """
        self._guard("publish")
        name = f"gen-{uuid.uuid4().hex[:12]}"
        folder = Path(self.root) / name
        for t, df in tables.items():
            df.write.parquet(f"{folder}/{t}.parquet")
            want, got = rel.fingerprint(df).first(), rel.fingerprint(self.spark.read.schema(df.schema).parquet(f"{folder}/{t}.parquet")).first()
            if want != got:
                raise OSError(f"{t}: wrote {want}, read {got}")
        swap = Path(self.root) / f".{POINTER}-{uuid.uuid4().hex[:6]}"
        swap.write_text(name)
        os.replace(swap, Path(self.root) / POINTER)
        return name


def archive(root: str, prefix: str, epoch: str) -> list[str]:
    """Renames all tables of a prefix aside under a manifest. A repeat with the same epoch does nothing; a half-done one is refused."""
    base = Path(root)
    manifest = base / f"{prefix}archive.json"
    done = json.loads(manifest.read_text()) if manifest.exists() else {}
    live = sorted(p.name for p in base.glob(f"{prefix}*.parquet") if not p.name.endswith("_v1.parquet"))
    if done.get("epoch") == epoch:
        if any((base / f"{n.removesuffix('.parquet')}_v1.parquet").exists() is False for n in done["tables"]):
            raise OSError("the archive is incomplete")
        return done["tables"]
    if any((base / f"{n.removesuffix('.parquet')}_v1.parquet").exists() for n in live):
        raise OSError("some tables are archived already")
    for n in live:
        os.replace(base / n, base / f"{n.removesuffix('.parquet')}_v1.parquet")
    manifest.write_text(json.dumps({"epoch": epoch, "tables": live}))
    return live
