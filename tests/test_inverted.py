"""The inverted index against the scan, parts, what is read; blocks of queries one after the other; long texts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusquery.functions import scores
from corpusquery.functions import text as T
from corpusquery.operators import dense, graph, inverted, ranking, sparse
from corpusquery.sources import tables


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    weights = [1000 / (k + 1) for k in range(300)]
    rows = [(f"c{i:04d}", " ".join(r.choices(words, weights, k=r.randint(0, 30)))) for i in range(900)] + [("none", None), ("blank", "")]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(320)], [3 if k < 5 else 1 for k in range(320)], k=r.randint(1, 12)))) for i in range(60)]
    return spark.createDataFrame([*rows, (90, "w0"), (91, "w0 w1 w0"), (92, "nothing-known"), (93, None), (94, "w1 w299 w2")], "query_id long, text string")


def listed(frame):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in frame.collect())


@pytest.mark.parametrize("first", [1, 40, 1 << 14])
def test_index_finds_what_the_scan_finds(spark, tmp_path, chunks, asked, first, monkeypatch):
    ix = sparse.index(chunks).kept()
    want = listed(sparse.search(ix, asked, 4, digits=6))
    stored = inverted.InvertedIndex(spark, str(tmp_path / "i")).add(ix, buckets=8)
    assert listed(stored.search(asked, 4, digits=6, first=first)) == want and len(want) > 200
    assert [x[:3] for x in listed(stored.search(asked, 7, k1=2.0, b=0.3, delta=0.0, first=first))] == [x[:3] for x in listed(sparse.search(ix, asked, 7, k1=2.0, b=0.3, delta=0.0))]


def test_blocks_of_a_common_term(spark, tmp_path, chunks, asked, monkeypatch):
    ix = sparse.index(chunks).kept()
    rows = inverted.postings(ix, 4, 16).collect()
    assert max(len(r.postings) for r in rows) <= 16 and sum(r.cf for r in rows) == ix.documents.agg(F.sum("dl")).first()[0]
    assert all(r.max_tf == max(p.tf for p in r.postings) and r.min_dl == min(p.dl for p in r.postings) and r.df == len(r.postings) for r in rows)
    want = {(r.term, r.chunk_id, r.tf, r.dl) for r in ix.postings.collect()}
    assert {(r.term, p.chunk_id, p.tf, p.dl) for r in rows for p in r.postings} == want
    monkeypatch.setattr(inverted, "BLOCK", 16)
    inverted.postings.__defaults__ = (inverted.BUCKETS, 16)
    try:
        stored = inverted.InvertedIndex(spark, str(tmp_path / "i")).add(ix, buckets=4)
    finally:
        inverted.postings.__defaults__ = (inverted.BUCKETS, 1024)
    assert listed(stored.search(asked, 5, digits=6, first=10)) == listed(sparse.search(ix, asked, 5, digits=6))


def test_parts_are_added_at_their_own_cost(spark, tmp_path, chunks, asked):
    ix, path = sparse.index(chunks), str(tmp_path / "i")
    stored = inverted.InvertedIndex(spark, path)
    low, high = (sparse.SparseIndex(ix.documents.filter(f)) for f in ("chunk_id < 'c0500'", "chunk_id >= 'c0500'"))
    stored.add(low, "a", buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("part=a/**/*.parquet")}
    stored.add(high, "b")
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("part=a/**/*.parquet")}
    assert listed(inverted.read(spark, path).search(asked, 5, digits=6)) == listed(sparse.search(ix, asked, 5, digits=6))
    with pytest.raises(ValueError):
        stored.add(low, "c", buckets=9)
    stored.add(sparse.SparseIndex(low.documents.limit(0)), "b")
    assert {x[2] for x in listed(stored.search(asked, 5))} <= {r.chunk_id for r in low.documents.collect()}
    stored.clear()
    assert stored.search(asked, 5).collect() == [] and stored.search(asked.limit(0)).columns == ["query_id", "chunk_id", "score", "rank"]


def test_only_the_queries_buckets_are_read(spark, tmp_path, chunks):
    stored = inverted.InvertedIndex(spark, str(tmp_path / "i")).add(sparse.index(chunks), buckets=32)
    bucket = spark.range(1).select(inverted.bucket_of(F.lit("w7"), 32)).first()[0]
    files = {r[0] for r in stored.table("postings", [bucket]).select(F.input_file_name()).distinct().collect()}
    there = list((tmp_path / "i").rglob("postings/part=*/bucket=*/*.parquet"))
    assert files and all(f"/bucket={bucket}/" in f for f in files) and len(files) < len(there) / 8
    plan = stored.table("postings", [bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"(bucket#" in plan.split("PartitionFilters")[1]


def test_blocks_of_queries_are_finished_in_turn(spark, chunks, asked, monkeypatch):
    ix = sparse.index(chunks).kept()
    want = listed(sparse.search(ix, asked, 3, digits=6))
    missing = listed(sparse.search(ix, asked, 3, digits=6, delta_on_missing=True))
    vectors = spark.range(200).select(F.col("id").alias("chunk_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    queries = vectors.filter("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    near = listed(dense.cosine_search(vectors, queries, 3, digits=6))
    open_, most = set(), [0]
    real = ranking.in_turn

    def watched(runs, search, empty, name):
        def one(block):
            rows, release = search(block)
            open_.add(id(block))
            most[0] = max(most[0], len(open_))
            return rows, lambda: (open_.discard(id(block)), release())

        return real(runs, one, empty, name)

    def kept_hits():
        files, where = tables.hadoop_path(spark, tables.own_dir(spark))
        return {n for n in (s.getPath().getName() for s in files.listStatus(where)) if n.startswith("hits-")}

    before = kept_hits()
    for module in (sparse, dense):
        monkeypatch.setattr(module, "in_turn", watched)
        monkeypatch.setattr(module, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(sparse, "EXPANDED", 50)
    assert listed(sparse.search(ix, asked, 3, digits=6)) == want and listed(dense.cosine_search(vectors, queries, 3, digits=6)) == near
    assert listed(sparse.search(ix, asked, 3, digits=6, delta_on_missing=True)) == missing
    assert most[0] == 1 and not open_
    assert kept_hits() == before


@pytest.mark.parametrize("unit", ["a-", "A-", "> ", "a_", "é", "-", "Aé-"])
def test_a_megabyte_without_a_break(spark, unit):
    scores.register(spark)
    row = spark.createDataFrame([(0, unit * (1_000_000 // len(unit)) + " Last-Word")], "query_id long, text string")
    got = row.select(T.tokens(F.col("text")).alias("t"), F.expr("corpus_tokens(text)").alias("u"), graph.named(F.col("text")).alias("n")).first()
    assert got.t == got.u and got.t[-1] == "last-word" and got.n[-1] == "last-word"
    assert graph.asked(row).count() >= 1


def test_tokens_follow_their_definition(spark):
    import regex

    r = random.Random(8)
    rows = [("".join(r.choice("aB1-_é ́.漢٣😀ª") for _ in range(r.randint(0, 25))),) for _ in range(3000)]
    got = spark.createDataFrame(rows, "t string").select("t", T.tokens(F.col("t")).alias("x"), graph.named(F.col("t")).alias("n")).collect()
    for row in got:
        # chains, by single hyphens, of words that are ASCII letters and digits throughout
        words = [(m.group(), m.start(), m.end()) for m in regex.finditer(r"[\w‌‍]+", row.t.lower())]
        want, end = [], None
        for w, a, b in words:
            if regex.fullmatch("[a-z0-9]+", w):
                if end is not None and row.t.lower()[end:a] == "-":
                    want[-1] += "-" + w
                else:
                    want.append(w)
                end = b
            else:
                end = None
        assert row.x == want, row.t
        assert row.n == [x.lower() for x in regex.findall(r"[\p{L}\p{Nd}_]+(?:-[\p{L}\p{Nd}_]+)*", row.t) if regex.search(r"^\p{Lu}.|-", x)], row.t
