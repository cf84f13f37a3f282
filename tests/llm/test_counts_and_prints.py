"""SimHash links, importance resampling and dominance counts against plain versions, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paneltide.llm import common, dominance, importance, lookup, simhash

ODD = "doc_id long, text string, fp long, n int, rank long, _hot boolean, row string"


def prose(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    base = [prose(rng, int(n)) for n in rng.integers(15, 120, 25)]
    near = [t.replace(t.split(" ")[3], "other") for t in base for _ in range(2)]
    odd = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "One TWO three", "ÄÖ ß x é́ 漢字 漢字 42", "a-b_c9", base[0].upper(), base[1], base[1], prose(rng, 40000), "x" * 200000, "w " * 3000]
    out = list(enumerate(base + near + odd))
    return out + [(3, base[3]), (3, base[4]), (None, base[5]), (None, prose(rng, 30))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, True, "r") for i, t in rows], ODD).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


# -- fingerprints and links ---------------------------------------------------------------------


def plain_print(text, hashed=lambda s: xxhash.xxh64_intdigest(s.encode(), 42)):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [hashed(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=2):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_classes(docs, rows, nothing):
    short = [r for r in rows if len(r[1] or "") < 50000]
    prints = {t: plain_print(t) for _, t in rows}
    got = simhash.digest(docs).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{prints[t]:016x}") for i, t in rows}
    want = plain_components([prints[t] for _, t in rows], [i for i, _ in rows])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{prints[t]:016x}", c) for (i, t), c in zip(rows, want))
    assert len(short) < len(rows)
    out = simhash.digest(nothing)
    assert out.columns == ["doc_id", "fingerprint", "component_id", "n_links"] and out.count() == 0


def test_hash_is_that_of_spark(spark):
    texts = ["a b c", "漢字 é x", "one"]
    want = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts] == [h % 2**64 for h in want]


@pytest.mark.parametrize("stretch", [1, 7, 50])
def test_stretches_of_a_text_change_nothing(monkeypatch, stretch):
    text = "  Ab cd\tef gh ij\nkl mn op qr st uv  wx yz " * 3
    whole, whole_ring = simhash.fingerprint(text.encode()), np.concatenate([b for b, _ in importance.Ring(3, 97).scan(text.encode())])
    monkeypatch.setattr(common.byte_words, "__defaults__", (stretch,))
    assert simhash.fingerprint(text.encode()) == whole
    assert np.array_equal(np.concatenate([b for b, _ in importance.Ring(3, 97).scan(text.encode())]), whole_ring)


def clouds(rng, n):
    """Fingerprints with everything that makes parts uneven: clouds of few-bit changes and halves that all share."""
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    out = set(rng.integers(0, 2**63, n, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(n // 6):
            out.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))}))
    out |= {int(x) & 0xFFFFFFFF | 0xABCD << 40 for x in rng.integers(0, 2**63, n // 2)}
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("layouts", [simhash.LAYOUTS, (4, 1), (1,)])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_equal_all_pairs(spark, layouts, radius):
    fp = clouds(np.random.default_rng(radius), 240)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    got = {tuple(r) for r in simhash.links(nodes, radius, layouts).collect()}
    signed = fp.view(np.int64).tolist()
    want = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= radius}
    assert got == want and len(want) > 20


def test_thresholds_fill_the_budget_and_avoid_frequent_values():
    rng = np.random.default_rng(2)
    masks = simhash.grouped(np.zeros((64, 64)), 3) + simhash.grouped(np.zeros((64, 64)), 1)
    fp = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    fp[:2900] = fp[:2900] & ~np.uint64(masks[0]) | np.uint64(masks[0]) & np.uint64(0x5555)  # one value of the first part is everywhere
    held = np.stack([np.bincount(simhash._slot(fp & np.uint64(m), i), minlength=simhash.SLOTS) for i, m in enumerate(masks[:-1])])
    plan = simhash.Plan(held, masks, [[0, 1, 2], [3]], len(fp))
    units = plan.thresholds(fp)
    assert (units[:2900, 0] == 0).all() and (units[2900:, 0] == 1).all()
    three = units[:, 3] == 0
    assert (units[three, :3].sum(1) == 3).all() and (units[~three, 3] == 3).all() and (units[~three, :3] == 0).all()


def test_correlated_bits_share_a_part(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (2000, 64))
    for k in range(1, 21):
        bits[:, 3 * k] = bits[:, 0] ^ (rng.random(2000) < 0.05)
    fp = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1).view(np.int64)
    likeness = simhash.correlations(spark.createDataFrame([(int(x),) for x in fp], "fp long"))
    want = np.abs(np.corrcoef(bits.T))
    assert np.allclose(likeness, want, atol=1e-9)
    masks = simhash.grouped(likeness, 3)
    assert masks[0] == sum(1 << 3 * k for k in range(21)) and sum(m.bit_count() for m in masks) == 64 and masks[0] & masks[1] == 0


# -- importance resampling ----------------------------------------------------------------------


def plain_runs(text, n=2):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ring_equals_checksums_of_whole_runs(rows, n):
    for _, text in rows:
        words, runs = plain_runs(text, n)
        parts = list(importance.Ring(n, 1009).scan(None if text is None else text.encode()))
        got = Counter(np.concatenate([b for b, _ in parts]).tolist()) if parts else Counter()
        assert got == Counter(zlib.crc32(r.encode()) % 1009 for r in runs) and sum(w for _, w in parts) == words


def test_resampling(spark, docs, rows, nothing):
    target = spark.createDataFrame([(i, t) for i, t in rows[:4]] + [(9, None)], "item_id long, text string")
    feats = [plain_runs(t) for _, t in rows]
    bucket = lambda r: zlib.crc32(r.encode()) % 10000
    s = Counter(bucket(r) for _, f in feats for r in f)
    t = Counter(bucket(r) for _, x in rows[:4] for r in plain_runs(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    want = []
    for (i, _), (words, f) in zip(rows, feats):
        weight = sum(gain(bucket(r)) for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    fit = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], -1 if w[0] is None else w[0]))
    got = importance.digest(docs, target).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got) == Counter(map(tuple, want))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25 * len(fit) // 100 + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(w[3], w[0]) for w in fit[: len(drawn)]]
    assert importance.digest(nothing, target).count() == 0
    assert {r.weight for r in importance.digest(docs.limit(3), nothing).collect()} <= set(range(-9000, 9000))


def test_ranks_of_ties_and_repeats(spark):
    df = spark.createDataFrame([(int(x), 7) for x in np.random.default_rng(1).integers(0, 9, 4000)], "a int, b int").repartition(7)
    df = common.written(df.withColumn("at", F.monotonically_increasing_id()), "test")
    got = lookup.ranked(df, [F.col("a").desc(), F.col("at")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 4001))
    assert [(-r.a, r["at"]) for r in got] == sorted((-r.a, r["at"]) for r in got)


def test_lookup_of_hot_null_and_unknown_keys(spark):
    keys = [1] * 5000 + [None] * 300 + list(range(2, 3000))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(6)
    values = spark.createDataFrame([(1, 5000, "hot")] + [(k, 1, str(k)) for k in range(2, 2500)], "k long, n long, v string")
    got = {r.i: r.v for r in lookup.looked_up(rows, values, ["k"], "n", len(keys)).collect()}
    assert got == {i: "hot" if k == 1 else None if k is None or k >= 2500 else str(k) for i, k in enumerate(keys)}


# -- dominance ----------------------------------------------------------------------------------


def plain_above(points):
    """(n, w) above each (slot, level, weight)."""
    s, l, w = (np.array(x, np.int64) for x in zip(*points))  # noqa: E741
    over = (s[None] <= s[:, None]) & (l[None] > l[:, None])
    return over.sum(1), (over * w[None]).sum(1)


@pytest.mark.parametrize("spread", [(3, 5), (200, 30), (20, 9000), (4000, 10**6)])
def test_dominance_equals_all_comparisons(spark, spread):
    rng = np.random.default_rng(spread[0])
    points = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(-spread[0], spread[0], 900), (rng.random(900) ** 3 * spread[1]).astype(int), rng.integers(1, 4, 900))]
    points += points[:40] + [points[0]] * 100
    df = spark.createDataFrame([(i, *p, "x") for i, p in enumerate(points)], "i long, a long, b long, w long, s string").repartition(5)
    got = {r.i: (r.n_above, r.w_above) for r in dominance.counted(df, "a", "b", "w").collect()}
    n, w = plain_above(points)
    assert got == {i: (n[i], w[i]) for i in range(len(points))}


def test_tiles_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        points = [(a, b, 1) for a in range(0, 70, 2) for b in range(0, 150, 3)]
        got = dominance.counted(spark.createDataFrame(points, "a long, b long, w long"), "a", "b", "w").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, _ = plain_above(points)
    assert {(r.a, r.b): r.n_above for r in got} == {(p[0], p[1]): x for p, x in zip(points, n)}


def test_sales(spark):
    kinds = "sale_id long, total double, sold_at timestamp_ntz, n long, s long, slot string"
    raw = [(1, 10.5, "2024-03-31 02:30:00"), (2, 99.995, "2024-03-31 02:59:59"), (3, None, "2024-03-31 03:00:00"), (4, 5.0, None), (5, 7.0, "2024-03-31 03:00:00"), (5, 7.0, "2024-03-31 03:00:00"), (None, 8.0, "2024-01-01 00:00:00"), (7, float("nan"), "2024-01-01 00:00:00"), (8, -3.2, "1969-12-31 23:59:59.5"), (9, -0.5, "2024-10-27 02:30:00")]
    df = spark.createDataFrame([(*r[:2], r[2], 1, 2, "x") for r in raw], kinds.replace("timestamp_ntz", "string")).withColumn("sold_at", F.col("sold_at").cast("timestamp_ntz"))
    want = None
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = sorted(map(tuple, dominance.digest(df).collect()), key=str)
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    by = {r[0]: r for r in got}
    assert by[3][1:] == (475515, None, None, None) and by[4][1:] == (None, 5, None, None) and by[7][2] is None and by[8][1:3] == (-1, -4)
    first = lambda s: 1 + zlib.crc32(str(s).encode()) % 2
    assert by[5][3:] == (3, first(1) + first(2) + 1) and by[2][2:] == (100, 0, 0) and sum(r[0] == 5 for r in got) == 2
    assert dominance.digest(df.limit(0)).columns == ["sale_id", "slot", "level", "n_sales", "n_rows"] and dominance.digest(df.limit(0)).count() == 0
