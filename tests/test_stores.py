"""Vectors in clusters against the scan; the vector store's parts, notes and compaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusquery.operators import clustered, dense
from corpusquery.sources.stores import MULTI, VectorStore


def listed(frame):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in frame.collect())


def test_clusters_find_what_the_scan_finds(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    tops = r.standard_normal((12, 16)) * 5
    x = np.concatenate([tops[r.integers(0, 12, 700)] + 0.4 * r.standard_normal((700, 16)), r.standard_normal((60, 16)), np.zeros((3, 16)), np.repeat(tops[:1], 40, axis=0)]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(3)
    queries = vectors.filter("chunk_id % 20 = 0 OR chunk_id > 795").withColumnRenamed("chunk_id", "query_id")
    stored = clustered.Clusters.write(vectors, str(tmp_path / "c"), 12)
    want, report = listed(dense.cosine_search(vectors, queries, 4, digits=6)), []
    assert listed(stored.search(queries, 4, digits=6, report=report)) == want and len(want) == 4 * queries.filter("query_id NOT BETWEEN 760 AND 762").count()
    read, clusters, scored, pairs = report[0]
    assert read <= clusters and scored < 0.6 * pairs
    # a block of one query leaves most clusters unread
    one = queries.filter("query_id = 20")
    report.clear()
    assert listed(stored.search(one, 4, digits=6, report=report)) == [w for w in want if w[0] == 20] and report[0][0] < clusters / 2
    monkeypatch.setattr(clustered, "BLOCK_QUERIES", 9)
    report.clear()
    assert listed(stored.search(queries, 4, digits=6, report=report)) == want and len(report) > 3
    # more than there are, and queries of length 0
    assert stored.search(queries.filter("query_id = 20"), 2000).count() == len(x)
    assert stored.search(queries.limit(0), 4).count() == 0
    assert clustered.Clusters.write(vectors.limit(0), str(tmp_path / "none")).search(queries, 4).count() == 0


def test_store_keeps_the_last_of_each(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    rows = lambda *x: spark.createDataFrame([(i, [float(a), 0.0]) for i, a in x], "chunk_id string, embedding array<float>")
    put = lambda *x: store.add(rows(*x).select("chunk_id"), rows(*x))
    there = lambda s=store: {r.chunk_id: r.norm for r in s.read().collect()}
    put(("a", 1), ("b", 2), ("c", 3))
    put(("d", 4))
    assert there() == {"a": 1, "b": 2, "c": 3, "d": 4}
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    put(("b", 20), ("e", 5))
    put(("b", 200), ("b", 100))
    assert there() == {"a": 1, "b": 100, "c": 3, "d": 4, "e": 5}
    store.delete(rows(("c", 0), ("unknown", 0)))
    assert there() == {"a": 1, "b": 100, "d": 4, "e": 5}
    put(("c", 33))
    want = there()
    assert want["c"] == 33
    store.compact()
    assert there() == want == there(VectorStore(spark, str(tmp_path / "v"))) and len(list((tmp_path / "v").glob("*.done"))) == 1
    assert "Join" not in store.read()._jdf.queryExecution().executedPlan().toString()
    put(("a", 7))
    assert there() == {**want, "a": 7}
    with pytest.raises(ValueError):
        wrong = spark.createDataFrame([("z", [1.0])], "chunk_id string, embedding array<float>")
        store.add(wrong.select("chunk_id"), wrong)
    store.clear()
    assert there() == {} and store.read().columns == ["chunk_id", "embedding", "norm"]
    multi = VectorStore(spark, str(tmp_path / "m"), MULTI)
    some = spark.createDataFrame([("a", [[1.0], [2.0]])], "chunk_id string, embeddings array<array<float>>")
    multi.add(some.select("chunk_id"), some)
    multi.add(some.select("chunk_id"), some.withColumn("embeddings", F.slice("embeddings", 1, 1)))
    assert [r.embeddings for r in multi.read().collect()] == [[[1.0]]]
