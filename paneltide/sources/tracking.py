"""Experiment log: runs with their figures, parameters and tags as rows of one Parquet table."""

from __future__ import annotations

import hashlib
import json
import logging
import subprocess

from pyspark.sql import DataFrame, SparkSession

LOG = "experiment string, run string, tags map<string,string>, metrics map<string,double>, params map<string,string>"


def config_hash(config: dict) -> str:
    """Ten hexadecimal digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]


def revision(folder: str = ".") -> str:
    """The short git revision of a folder, ``nogit`` where there is none."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=True)
    except (OSError, subprocess.SubprocessError):
        return "nogit"
    return done.stdout.strip()


def split(row: dict) -> tuple[dict[str, float], dict[str, str]]:
    """(metrics, params) of a result row: numbers that are not NaN, and text cut to 200 characters; the strategy is neither."""
    numbers = {k: float(v) for k, v in row.items() if isinstance(v, (int, float)) and v == v}
    return numbers, {k: v[:200] for k, v in row.items() if isinstance(v, str) and k != "strategy"}


def log_runs(spark: SparkSession, path: str, rows: list[dict], config: dict, experiment: str, asof: str = "", folder: str = ".") -> bool:
    """Appends one row for each result and says whether it did. A log that cannot be written never fails the run."""
    try:
        tags = {"git_sha": revision(folder), "config_hash": config_hash(config), "data_asof": asof}
        made = [(experiment, str(row.get("strategy", "run")), tags, *split(row)) for row in rows]
        spark.createDataFrame(made, LOG).coalesce(1).write.mode("append").parquet(path)
    except Exception as failed:
        logging.getLogger(__name__).warning("experiment log left out: %s", type(failed).__name__)
        return False
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)
