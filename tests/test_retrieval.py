import math

import pytest
from pyspark.sql import functions as F

from corpusquery.functions.text import tokens
from corpusquery.operators import dense, fusion, graph, sparse

VECTORS = "chunk_id string, embedding array<float>"
QUERY = "query_id long, embedding array<float>"


def one(spark, vectors, query, k):
    return [(r.chunk_id, r.score) for r in dense.cosine_search(spark.createDataFrame(vectors, VECTORS), spark.createDataFrame([(0, query)], QUERY), k).orderBy("rank").collect()]


def test_nearest_first(spark):
    got = one(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], [1.0, 0.0], 3)
    assert [i for i, _ in got] == ["a", "c", "b"] and math.isclose(got[1][1], 2**-0.5, rel_tol=1e-6)


def test_zero_vectors_and_empty_store(spark):
    assert one(spark, [("a", [1.0])], [0.0], 3) == []
    assert one(spark, [], [1.0], 3) == []
    assert one(spark, [("a", [0.0, 0.0]), ("b", [-1.0, 0.0])], [1.0, 0.0], 3) == [("a", 0.0), ("b", -1.0)]


def test_ties_and_k(spark):
    rows = [(x, [1.0, 0.0]) for x in "dbca"]
    assert [i for i, _ in one(spark, rows, [2.0, 0.0], 2)] == ["a", "b"]
    assert len(one(spark, rows, [1.0, 0.0], 0)) == 4
    with pytest.raises(ValueError):
        one(spark, rows, [1.0, 0.0], -1)


def test_maxsim(spark):
    x = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    docs = spark.createDataFrame([("m1", [x[0], x[0], x[0]]), ("m2", [x[0], x[1], x[2]]), ("m3", [x[2], x[2], x[2]]), ("none", [])], "chunk_id string, embeddings array<array<float>>")
    asked = spark.createDataFrame([(0, [x[0], x[1]])], "query_id long, embeddings array<array<float>>")
    got = dense.maxsim_search(docs, asked, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("m2", 2.0), ("m1", 1.0), ("m3", 0.0)]
    assert dense.maxsim_search(docs.limit(0), asked).count() == 0


def test_one_dimension(spark):
    with pytest.raises(ValueError):
        dense.check_dimensions(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], VECTORS))


def test_tokens(spark):
    rows = spark.createDataFrame([("Café foo_bar naïve QX-42b x-1-b, The END",), (None,)], "t string")
    assert [r[0] for r in rows.select(tokens(F.col("t"))).collect()] == [["qx-42b", "x-1-b", "the", "end"], []]


CHUNKS = [("c1", "The QX-42b guided the lander"), ("c2", "memory and cores of a small machine"), ("c3", "Lark-9-ZT-7 lifted the stack"), ("c4", "")]


def by_hand(chunks, query, k1=1.5, b=0.75, delta=0.5):
    cut = {i: t.lower().split() for i, t in chunks}
    n, avg = len(cut), sum(map(len, cut.values())) / len(cut)
    out = {}
    for term in query.lower().split():
        df = sum(term in x for x in cut.values())
        for i, x in cut.items():
            if term in x:
                ctd = x.count(term) / (1 - b + b * len(x) / max(1, avg))
                out[i] = out.get(i, 0) + (math.log(n + 1) - math.log(df + 0.5)) * (k1 + 1) * (ctd + delta) / (k1 + ctd + delta)
    return out


def test_bm25(spark):
    ix = sparse.index(spark.createDataFrame(CHUNKS, "chunk_id string, text string"))
    asked = spark.createDataFrame([(0, "QX-42b"), (1, "Lark-9-ZT-7"), (2, "the the stack"), (3, "unknown"), (4, "")], "query_id long, text string")
    got = {}
    for r in sparse.search(ix, asked).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert set(got) == {0, 1, 2} and list(got[0]) == ["c1"] and list(got[1]) == ["c3"]
    want = by_hand(CHUNKS, "the the stack")
    assert got[2].keys() == want.keys() and all(math.isclose(got[2][i], want[i]) for i in want)


def test_bm25_with_the_share_of_missing_terms(spark):
    ix = sparse.index(spark.createDataFrame(CHUNKS, "chunk_id string, text string"))
    asked = spark.createDataFrame([(0, "QX-42b")], "query_id long, text string")
    rows = sparse.search(ix, asked, 3, delta_on_missing=True).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c1", "c2", "c3"] and rows[1].score == pytest.approx(rows[2].score) and rows[1].score > 0


RANKED = "query_id long, chunk_id string, rank int, score double"


def test_rrf(spark):
    near = spark.createDataFrame([(0, "A", 1, 0.9), (0, "B", 2, 0.8)], RANKED)
    words = spark.createDataFrame([(0, "B", 1, 5.0), (0, "C", 2, 4.0)], RANKED)
    rows = fusion.fuse(near, words).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["B", "A", "C"]
    assert [round(r.rrf_score, 8) for r in rows] == [0.03252247, 0.01639344, 0.01612903]
    assert (rows[1].sparse_rank, rows[1].sparse_score, rows[2].dense_rank) == (-1, 0.0, -1)


def test_rrf_ties_follow_the_dense_list(spark):
    near = spark.createDataFrame([(0, "z", 1, 0.9)], RANKED)
    words = spark.createDataFrame([(0, "a", 1, 5.0)], RANKED)
    assert [r.chunk_id for r in fusion.fuse(near, words).orderBy("rank").collect()] == ["z", "a"]


def test_plans_cut_before_the_shuffle(spark, capsys):
    ix = sparse.index(spark.createDataFrame(CHUNKS, "chunk_id string, text string"))
    sparse.search(ix, spark.createDataFrame([(0, "the")], "query_id long, text string")).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_graph_modes(spark):
    chunks = spark.createDataFrame([("c1", "Alpha met Beta"), ("c2", "Beta saw Gamma twice"), ("c3", "nothing here")], "chunk_id string, text string")
    g, asked = graph.extract(chunks), spark.createDataFrame([(0, "who is Alpha?")], "query_id long, text string")
    rows = lambda mode: [(r.chunk_id, r.score) for r in graph.search(g, asked, mode).orderBy("rank").collect()]
    assert rows("local") == [("c1", 1.5), ("c2", 0.5)] and rows("global") == [("c1", 1.0)] and rows("hybrid") == [("c1", 2.5), ("c2", 0.5)]
    assert graph.search(g, asked, "naive", naive=lambda q, k: (q.count(), k)) == (1, 5)
    with pytest.raises(ValueError):
        graph.search(g, asked, "other")


def test_index_parts(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = lambda *some: sparse.index(spark.createDataFrame(some, "chunk_id string, text string"))
    assert sparse.SparseIndex.read(spark, path).documents.count() == 0
    ix = rows(("a", "red apples"), ("b", "green")).write(path)
    ix = sparse.index(spark.createDataFrame([("a", "red apples"), ("b", "green")], "chunk_id string, text string")).write(path)
    assert ix.stats.first() == (2, 1.5) and {tuple(r) for r in ix.terms.collect()} == {("red", 1, 1), ("apples", 1, 1), ("green", 1, 1)}
    again = ix.write(path)  # the index that is read from is the one that is replaced
    assert again.documents.count() == 2
    rows(("c", "red red")).write(path, part="more")
    both = rows(("c", "red red blue")).write(path, part="more")
    assert both.documents.count() == 3 and {tuple(r) for r in both.terms.filter("term = 'red'").collect()} == {("red", 2, 3)}
    assert {(r.term, r.chunk_id, r.tf, r.dl) for r in both.postings.filter("chunk_id = 'c'").collect()} == {("red", "c", 2, 3), ("blue", "c", 1, 3)}
    sparse.SparseIndex.clear(spark, path)
    assert sparse.SparseIndex.read(spark, path).documents.count() == 0


def test_bm25_in_blocks_and_with_ties(spark, monkeypatch):
    words = "a b c d e f".split()
    chunks = [(f"c{i:02d}", " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(40)] + [(f"t{i}", "z same") for i in range(30)]
    asked = [(i, " ".join(words[i % 6 : i % 6 + 2])) for i in range(9)] + [(9, "same same")]
    ix = sparse.index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    queries = spark.createDataFrame(asked, "query_id int, text string")
    want = {}
    for q, t in asked:
        rows = sorted(by_hand(chunks, t, 1.2, 0.5, 0.3).items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        want[q] = [i for i, _ in rows]
    found = lambda: {q: [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] for rows in [sparse.search(ix, queries, 4, digits=6, k1=1.2, b=0.5, delta=0.3).collect()] for q in want}
    assert found() == want and want[9] == ["t0", "t1", "t10", "t11"]
    monkeypatch.setattr(sparse, "BLOCK_TERMS", 3)
    monkeypatch.setattr(sparse, "CELLS", 8)
    assert found() == want
