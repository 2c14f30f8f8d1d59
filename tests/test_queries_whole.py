"""Queries over their whole tables: against brute force on fixtures, and against SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from corpusquery import queries
from corpusquery.operators import dense

DATA = "/root/testdata/sf0.001"
#: One for each kind of line end, with quotes, white space at a window's edge, and texts below, at and beyond a window.
TEXTS = ["x" * 399, "x" * 400, "ab c'd\"e\n" * 150, ("é" * 338 + "  ") * 4, "a\r\nb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029j", "'\"", "", None, "y" * 5000, "tail " * 300]


def against_sql(frame, name, folder=DATA, files=""):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{files}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(frame.columns)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in at) for r in found.fetchall()))) == sorted(map(str, map(tuple, frame.select(columns).collect())))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def windows(p, size=400, step=340):
    if len(p) <= size:
        return [p]
    last = -(-(len(p) - size) // step) * step
    return [w for w in (p[s : s + size].strip() for s in range(0, last + 1, step)) if w]


def test_assignments_of_whole_documents(spark, texts):
    want = []
    for i, t in enumerate(TEXTS):
        value = "".join(" " if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\"'" else c for c in t or "").strip()
        want += [(f"{i}#chunk-{k:04d}", x) for k, x in enumerate([*windows(value), "", f"plain line{i}"])]
    got = queries.QUERIES["c4_c5_assignment_chunks"](spark, texts)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_assignments_of_whole_documents_as_sql(spark):
    frame = queries.QUERIES["c4_c5_assignment_chunks"](spark, DATA)
    against_sql(frame, "c4_c5_assignment_chunks")
    assert frame.selectExpr("count(distinct split(chunk_id, '#')[0])").first()[0] == spark.read.parquet(f"{DATA}/documents.parquet").count()


STATED = ["k2_j1_s8_cosine_top5", "k3_j2_d5_d6_maxsim_top5", "f1_j4_k4_d7_a13_rrf_fusion", "r1_j5_k5_s18_rerank", "k6_rerank_bypass"]


@pytest.mark.parametrize("name", STATED)
def test_stated_queries_as_sql(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    against_sql(frame, name)
    ids = range(0, 500, 20) if "maxsim" not in name else range(0, 63, 20)
    assert {r.query_id for r in frame.select("query_id").distinct().collect()} == set(ids)


def test_stated_queries_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_VALUES", 32)
    x = np.random.default_rng(1).normal(size=(170, 8)).astype("float32")
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = {q: sorted(range(170), key=lambda i: (-np.floor(unit[q] @ unit[i] * 1e6 + 0.5), i))[:5] for q in range(0, 170, 20)}
    got = queries.QUERIES["k2_j1_s8_cosine_top5"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    assert {q: [r.chunk_id for r in got if r.query_id == q] for q in near} == near and len(got) == 45


@pytest.mark.parametrize("name, column", [("s1_tokens", "digest"), ("p5_p7_s16_judge_prompts", "answer")])
def test_digests_of_whole_texts(spark, tmp_path, name, column):
    against_sql(queries.QUERIES[name](spark, DATA), name)
    long = "word " * 200
    spark.createDataFrame([(0, long + "one"), (1, long + "two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).select(column).distinct().count() == 2
