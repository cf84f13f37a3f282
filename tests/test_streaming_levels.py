"""The adaptive level on a stream: late and unordered labels and a restart give the batch's intervals."""

from datetime import datetime, timedelta
from random import Random

import pytest

from paneltide.operators import conformal as cf
from paneltide.streaming import levels

SCHEMA = "config string, code string, i bigint, ts timestamp_ntz, q10 double, q90 double, y double"
TARGETS, DELAY, WINDOW, LEAST = {"a": 0.2, "b": 0.1}, 3, 8, 12


def moment(i):
    return datetime(2026, 1, 1) + timedelta(days=i)


def made(days, rng):
    """(forecast, label) of each config, code and day."""
    out = []
    for config in TARGETS:
        for i in range(days):
            for code in "ABCD":
                low = rng.gauss(-1, 0.3)
                crossed = rng.random() < 0.05
                y = None if rng.random() < 0.1 else rng.gauss(0, 1.5)
                ends = (low, low - 0.2) if crossed else (low, low + 2)
                out.append(((config, code, i, moment(i), *ends, None), (config, code, i, moment(i + DELAY - 1), None, None, y)))
    return out


def run(spark, folder, where, out):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = levels.adaptive(source, TARGETS, 0.05, "4 days", LEAST, WINDOW, DELAY)
    q = stream.writeStream.format("parquet").option("checkpointLocation", where).option("path", out).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200)


@pytest.fixture()
def keyed_store(spark):
    key, value = levels.STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_stream_equals_batch_after_a_restart(spark, tmp_path, keyed_store):
    rng, days = Random(4), 30
    pairs = made(days, rng)
    folder, where, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    rows = [f for f, _ in pairs] + [y for _, y in pairs if y[-1] is not None]
    # Each row comes up to three days after its time; a last row of a later day lets all days be decided.
    late = {r: r[3] + timedelta(days=rng.choice([0, 0, 0, 1, 3])) for r in rows}
    cuts = [moment(0), moment(9), moment(17), moment(days + 20)]
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        batch = [r for r in rows if lo <= late[r] < hi]
        rng.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, where, out)  # a query of its own: state comes from the checkpoint
    end = [("a", "Z", 10**6, moment(days + 60), None, None, 0.0)]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, where, out)

    batch = [(f[0], f[1], f[3].date(), f[2], f[4], 0.0, f[5], y[-1]) for f, y in pairs]
    frame = spark.createDataFrame(batch, "config string, code string, d date, i bigint, q10 double, q50 double, q90 double, y double")
    expected = cf.adaptive(frame, TARGETS, 0.05, LEAST, WINDOW, DELAY).drop("d")
    plain = lambda df: sorted((r["config"], r["i"], r["code"], *(None if v is None or v != v else round(v, 9) for v in (r["lower"], r["upper"], r["alpha_D"])), r["n_calib"], r["quality_flag"]) for r in df.collect())
    got, want = plain(spark.read.parquet(out)), plain(expected)
    key = lambda rows: [tuple(map(str, r)) for r in rows]
    assert len(want) == 2 * 4 * days and key(got) == key(want)
    assert len({r[5] for r in want}) > 10 and any(r[7].endswith("crossing") for r in want)
