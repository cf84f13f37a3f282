"""The pipeline's stages, one by one on what the one before kept, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from paneltide.llm import decontaminate, packing, toxicity

from test_operators import ODD, plain_classes, plain_lines, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, shared lines, copies and near copies, benchmark passages, and odd rows."""
    rng = np.random.default_rng(31)
    where = str(tmp_path_factory.mktemp("sf"))
    bad = ["zorgword", "vileterm"]
    rows, toxic = [], set()
    for i in range(160):
        w = words(rng, int(rng.integers(30, 80))).split(" ")
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), bad[int(rng.integers(2))])
        rows.append((i, " ".join(w)))
    items = [(k, words(rng, 12)) for k in range(6)]
    line = "A line that many documents share"
    rows += [(200 + i, f"{words(rng, 20)}\n{line}\n{words(rng, 20)}") for i in range(5)]
    rows += [(300 + i, rows[i * 7 + 1][1]) for i in range(4)] + [(310 + i, rows[i * 7 + 2][1] + " one more") for i in range(4)]
    rows += [(400 + i, f"{words(rng, 15)} {t} {words(rng, 15)}") for i, (_, t) in enumerate(items)]
    rows += [(500, None), (501, ""), (502, "one two"), (1, rows[1][1]), (None, words(rng, 40))]
    docs = spark.createDataFrame([(i, t, 1, "r", 2, len(t) if t is not None else None, "h") for i, t in rows], ODD)
    docs.repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, toxic, items


def test_each_stage(spark, folder):
    where, toxic, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    start = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, where).cache()
    before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in kept.collect()]
    gone = {i for i, _ in (Counter(before) - Counter(after))}
    assert kept.columns == start and not Counter(after) - Counter(before)
    copies = {i for i, t in before if t is not None and t in {x for k, x in before if k in toxic}}
    assert len(gone & (toxic | copies)) >= 0.95 * len(toxic) and len(gone - toxic - copies) <= 0.05 * len(before)
    scores = {(r.row.doc_id, r.row.text): r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{where}/labels.parquet"))).collect()}
    assert Counter(after) == Counter(x for x in before if scores[x] < toxicity.THRESHOLD)

    lines = stages["line_dedup"](spark, kept, where).cache()
    got = [(r.doc_id, r.text) for r in lines.collect()]
    assert Counter((i, t or "") for i, t in got) == Counter((i, "\n".join(b)) for i, _, b in plain_lines(after)) and lines.columns == start
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    single = stages["near_dedup"](spark, lines, where).cache()
    one = [(r.doc_id, r.text) for r in single.collect()]
    named, n = plain_classes(got)
    assert single.columns == start and len(one) == n and not Counter(one) - Counter(got)

    clean = stages["decontamination"](spark, single, where).cache()
    left = [(r.doc_id, r.text) for r in clean.collect()]
    matcher = decontaminate.Matcher([(k, decontaminate.normal(t)) for k, t in items], 0.0)
    assert clean.columns == start and not [i for i, t in left if matcher.find(decontaminate.normal(t))]
    lost = Counter(one) - Counter(left)
    assert lost and all(any(decontaminate.normal(t) in decontaminate.normal(text) for _, t in items) for _, text in lost)

    encode = packing.encoder(packing.default_vocabulary())
    packed = stages["packing"](spark, clean, where).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((i, len(encode(t or "")) + 1) for i, t in left)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(b)[0][0] == 0 and sum(x for _, x in b) <= 1024 for b in bins.values())

    whole = corpus_pipeline.run(spark, where).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
