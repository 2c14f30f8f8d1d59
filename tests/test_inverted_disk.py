"""What the inverted index writes: no shuffle to add a part, and none of queries by chunks to search it."""

import os
import random

import pytest

from corpusquery.operators import inverted, sparse


def shuffled(spark) -> dict[str, int]:
    """Shuffle files of the session, and their sizes."""
    found = {}
    for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for where, _, names in os.walk(str(top)):
            found |= {n: os.path.getsize(f"{where}/{n}") for n in names if n.startswith("shuffle_") and n.endswith(".data")}
    return found


@pytest.fixture
def common(spark):
    """Chunks and queries that share many common words."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    chunks = spark.createDataFrame([(f"c{i:05d}", " ".join(r.choices(words, k=40))) for i in range(4000)], "chunk_id string, text string").repartition(4)
    return chunks, spark.createDataFrame([(q, " ".join(r.choices(words, k=30))) for q in range(150)], "query_id long, text string").repartition(2)


def test_disk_follows_the_postings(spark, tmp_path, common):
    chunks, asked = common
    ix = sparse.index(chunks).kept()
    before = shuffled(spark)
    stored = inverted.InvertedIndex(spark, str(tmp_path / "i")).add(ix)
    added = {n: s for n, s in shuffled(spark).items() if n not in before}
    found = sorted(map(tuple, stored.search(asked, 5, digits=6).collect()))
    searched = {n: s for n, s in shuffled(spark).items() if n not in before and n not in added}
    assert found == sorted(map(tuple, sparse.search(ix, asked, 5, digits=6).collect())) and len(found) == 750
    n = ix.postings.count()
    # a row of statistics; then postings once for each of two rounds, not once for each query (150 here)
    assert sum(added.values()) < 4096
    assert 0 < sum(searched.values()) < 16 * n


def test_segments_and_blocks_of_queries(spark, tmp_path, common, monkeypatch):
    """Several segments a task, and several blocks of queries, give what one gives; two rows of one query are one."""
    chunks, asked = common
    ix = sparse.index(chunks).kept()
    want = sorted(map(tuple, sparse.search(ix, asked, 3, digits=6).collect()))
    for name, value in {"SEGMENT": 300, "BLOCK_QUERIES": 40, "CELLS": 1000}.items():
        monkeypatch.setattr(inverted, name, value)
    stored = inverted.InvertedIndex(spark, str(tmp_path / "i")).add(ix, buckets=4)
    heads = stored.table("postings", [inverted.HEADS]).selectExpr("segment", "size(chunk_ids) AS n").collect()
    assert len({h.segment for h in heads}) == len(heads) >= 14 and max(h.n for h in heads) <= 300 and sum(h.n for h in heads) == 4000
    assert sorted(map(tuple, stored.search(asked, 3, digits=6).collect())) == want
    twice = spark.createDataFrame([(1, "w1 w2"), (1, "w2 w3"), (2, "w1 w2 w2 w3")], "query_id long, text string")
    got = {q: [(r.chunk_id, r.score, r.rank) for r in stored.search(twice, 4, digits=6).orderBy("rank").collect() if r.query_id == q] for q in (1, 2)}
    assert got[1] == got[2] and len(got[1]) == 4
