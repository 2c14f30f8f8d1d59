"""Graph search where the mentions lie: what is made for it, what is shuffled, and blocks of queries."""

import random

import pytest
from pyspark.sql import functions as F

from corpusquery import providers, queries
from corpusquery.operators import graph
from corpusquery.sources import tables
from corpusquery.sources.graph_store import GraphStore


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(3)
    words = [f"N{k}" for k in range(60)] + ["with", "x-ray", "a--B1"]
    return spark.createDataFrame([(f"c{i:03d}", " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(300)], "chunk_id string, text string").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, f"of N{i} and N{2 * i} and N{i}?") for i in range(20)] + [(90, "nothing"), (91, None)], "query_id long, text string")


def listed(rows):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in rows.collect())


def ranked(scores, k):
    out = {}
    for r in scores.collect():
        out.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    return sorted((q, i + 1, c, -s) for q, found in out.items() for i, (s, c) in enumerate(sorted(found)[:k]))


def test_a_search_by_names_makes_no_tables_of_the_graph(spark, chunks, asked, monkeypatch):
    made, real = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (made.append(name), real(df, name))[1])
    g = graph.extract(chunks)
    got = {mode: listed(graph.search(g, asked, mode, 4)) for mode in graph.MODES[1:]}
    assert not {"extracted", "nodes", "edges", "told"} & set(made)
    whole = graph.extract(chunks).kept()
    whole.said = None
    assert got == {mode: listed(graph.search(whole, asked, mode, 4)) for mode in graph.MODES[1:]} and all(len(x) > 70 for x in got.values())
    assert got["global"] == ranked(graph.global_(whole, asked), 4)


@pytest.mark.parametrize("most", [1, 60, 1 << 21])
def test_no_pair_of_query_and_chunk_is_shuffled(spark, chunks, asked, monkeypatch, most):
    g = graph.extract(chunks)
    want = ranked(graph.local(g, asked), 3)
    monkeypatch.setattr(graph, "BLOCK_KEYS", most)
    monkeypatch.setattr(graph, "EXPANDED", 40)
    rows = graph.search(g, asked, "local", 3)
    assert listed(rows) == want and len(want) == 60
    if most > 60:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate [query_id" not in plan


def test_weights_of_an_embedder(spark, chunks, asked):
    g = graph.extract(chunks).embedded(providers.LetterEmbedder)
    some = asked.filter("query_id < 6")
    both = [ranked(way(g, some, providers.LetterEmbedder, 5, 6), 4) for way in (graph.local, graph.global_)]
    assert both == [listed(graph.search(g, some, mode, 4, embedder=providers.LetterEmbedder, near=5, digits=6)) for mode in ("local", "global")]


def test_names_follow_their_definition(spark):
    import regex

    r = random.Random(11)
    rows = [("".join(r.choice("aBÉé1_- -.٣") for _ in range(r.randint(0, 30))),) for _ in range(3000)]
    for row in spark.createDataFrame(rows, "t string").select("t", graph.named(F.col("t")).alias("n")).collect():
        assert row.n == [x.lower() for x in regex.findall(r"[\p{L}\p{Nd}_]+(?:-[\p{L}\p{Nd}_]+)*", row.t) if regex.search(graph.NAME, x)], row.t


def left(spark, *names):
    """Tables of these names that hold a file."""
    files, where = tables.hadoop_path(spark, tables.own_dir(spark))
    folders = [s.getPath() for s in files.listStatus(where)] if files.exists(where) else []
    return {f.getName() for f in folders if f.getName().rpartition("-")[0].split("-")[0] in names}


def test_a_store_leaves_no_second_copy(spark, tmp_path, chunks):
    names = ("inserted", "new", "chunks", "names", "extracted", "nodes", "edges")
    docs = chunks.select(F.col("chunk_id").alias("source"), "text")
    before, store = left(spark, *names), GraphStore(spark, str(tmp_path / "g"))
    assert store.insert(docs) == 300 and store.insert(docs) == 0
    assert left(spark, *names) == before
    assert store.graph().entities.count() == graph.extract(chunks).entities.count()


def test_tokens_go_once_the_postings_stand(spark):
    before = left(spark, "tokens")
    assert queries.inverted_top5(spark, "/root/testdata/sf0.001").count() > 0
    assert left(spark, "tokens") == before


@pytest.fixture(scope="module")
def wanted(spark, chunks):
    """Queries by names, 70 so that their bits take two numbers, and what the tables of the graph give for them."""
    many = spark.createDataFrame([(i, f"N{i % 60} N{i % 60} of N{i % 7}, x-ray?") for i in range(70)] + [(None, "N1"), (91, None), (92, "Nowhere")], "query_id long, text string")
    whole = graph.extract(chunks).kept()
    whole.said = None
    by_pairs = {mode: [tuple(r) for r in graph.search(whole, many, mode, 4).select("query_id", "chunk_id", "score", "rank").collect()] for mode in graph.MODES[1:]}
    return many, {mode: sorted(rows, key=str) for mode, rows in by_pairs.items()}


@pytest.mark.parametrize("limits", [{}, {"BIT_BYTES": 1, "BIT_MENTIONS": 50, "CELLS": 700}, {"BIT_QUERIES": 40}, {"BIT_NAMES": 1}])
def test_weights_of_names_are_bits(spark, chunks, wanted, monkeypatch, limits):
    many, want = wanted
    made, real = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (made.append(name), real(df, name))[1])
    monkeypatch.setattr(graph, "BLOCK_KEYS", 1000)
    for name, value in limits.items():
        monkeypatch.setattr(graph, name, value)
    for mode in graph.MODES[1:] if not limits else ["hybrid"]:
        made.clear()
        rows = graph.search(graph.extract(chunks), many, mode, 4)
        assert sorted(map(tuple, rows.select("query_id", "chunk_id", "score", "rank").collect()), key=str) == want[mode] and len(want[mode]) > 270
        if limits.get("BIT_NAMES") is None:
            assert made == ["names", "asked"] + ["hood"] * (mode != "global") * (2 if "BIT_QUERIES" in limits else 1)
