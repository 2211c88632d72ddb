"""The corpus pipeline's stages on a small folder of tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_ops import linked, prose, shingles, words

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    spell = lambda x: "".join("klmnopqrst"[int(c)] if c.isdigit() else c for c in x)
    rows, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        t = " ".join(f"W{rng.randrange(50)}$$$" for _ in range(50)) if bad else spell(prose(rng, rng.randrange(40, 90))) + ".\nrecurring footer of the site number %d" % i
        rows.append((i, t, ("en", "de")[i % 2], f"src{i % 4}", len(t)))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(200 + k, rows[k][1] + " x", "en", "src1", 1) for k in range(1, 6)]
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0), (1, rows[1][1], "de", "src1", 5), (2, spell(prose(rng, 40)), "en", "src0", 9), (302, "one long line " * 30_000, "en", "src3", 1), (None, rows[7][1] + " without id" * 30, "en", "src2", 3)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").withColumn("node", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
    quality, lines, near, mixed, packed = seen
    assert all(d.columns == cp.COLUMNS for d in seen[:4])
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen[:4]]
    assert not any(i is not None and i < 120 and i % 6 == 0 for i in ids[0])
    assert sum(i is not None and i < 120 and i % 6 != 0 for i in ids[0]) >= 99
    text = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert sorted(map(str, ids[1])) == sorted(map(str, ids[0]))
    assert not any("footer" in (t or "") for i, t in text.items() if i is not None and i < 120)
    assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in lines.collect())
    rows = list({(r["doc_id"], r["text"]) for r in lines.collect()})
    sets = [shingles(t) for _, t in rows]
    groups = {}
    for k, (i, _) in zip(linked(sets), rows, strict=True):
        groups.setdefault(k, set()).add(i)
    kept = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert len(kept) == len(groups) and None in ids[2]
    where = {row: k for k, row in zip(linked(sets), rows, strict=True)}
    assert {where[row] for row in kept} == set(groups)
    total = sum(len(words(r["text"])) for r in near.collect())
    assert 0.75 * total <= sum(len(words(r["text"])) for r in mixed.collect()) <= 0.8 * total + sum(sorted(len(words(r["text"])) for r in near.collect())[-12:])
    assert set(ids[3]) <= set(ids[2]) and {r["doc_id"] for r in packed.collect()} == set(ids[3])


def test_run(spark, folder):
    assert cp.run(spark, folder).count() > 0


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == cp.COLUMNS


def test_stages_begin_in_collected_heaps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)

    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())

    for name, stage in cp.STAGES:
        before = full_collections()
        stage(spark, docs, folder)
        assert full_collections() > before, name
