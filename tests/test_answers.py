import pytest
from pyspark.sql import functions as F

from corpusquery import providers
from corpusquery.functions import text as T
from corpusquery.functions.scores import clamp, parse_ranking, parse_score, register
from corpusquery.operators import prompts, rerank, triad
from corpusquery.plans.config import Config, flag
from corpusquery.plans.pipelines import Basic, Hybrid
from corpusquery.sources.stores import MULTI, VectorStore
from corpusquery.sources.textfile import read_text


@pytest.mark.parametrize(
    "reply, score",
    [
        ('{"score": 0.87}', 0.87), ('{"score": "0.92"}', 0.92), ("I would say 0.65 here", 0.65), ("Score: 1", 1.0), ('{"score": 1.5}', 1.0), ('{"score": -0.2}', 0.0), ("no digits", 0.5), (None, 0.5), ("", 0.5), ("8/10", 1.0), ("-0.2", 0.2),
        ("1e-3", 1.0), ("null", 0.5), ('{"score": NaN}', 1.0), ('```json\n{"score": 0.4}\n```', 0.4), ('{"score": 0.1, "score": 0.3}', 0.3), ('{"score": 0.9} and 0.1', 0.9), ('{"score": true}', 1.0), ("0.7", 0.7), ("[0.6]", 0.6),
    ],
)
def test_scores_in_replies(reply, score):
    assert parse_score(reply) == pytest.approx(score)


def test_rankings_in_replies():
    assert parse_ranking('```json\n[{"index": 1, "score": "8"}, {"x": 1}, {"index": 1, "score": 2}]\n```') == [{"index": 1, "score": 2.0}]
    assert parse_ranking('[{"index": "0", "score": 3}]') == [] == parse_ranking("[]")
    assert all(parse_ranking(x) is None for x in (None, "no", '[{"index": 0}]', "5", "[5]", '["index"]', '{"index": 0, "score": 1}'))


def test_columns(spark):
    rows = spark.createDataFrame([(1.5,), (-0.3,), (0.75,), (0.25,), (float("nan"),)], "x double")
    got = rows.select(clamp(F.col("x")), T.bar(clamp(F.col("x"))), T.label(clamp(F.col("x")))).collect()
    assert [r[0] for r in got] == [1, 0, 0.75, 0.25, 1] and [r[1].count("█") for r in got] == [10, 0, 8, 2, 10] and [r[2] for r in got] == ["pass", "fail", "warn", "fail", "pass"]
    register(spark)
    got = spark.sql("select extract_score('score 0.3', 0.5D), corpus_tokens('Foo_bar QX-42b x'), cosine(array(1F, 0F), array(1F, 1F)), cosine(array(1F), array(0F))").first()
    assert got[0] == 0.3 and got[1] == ["qx-42b", "x"] and got[2] == pytest.approx(2**-0.5) and got[3] == 0.0


CANDIDATES = [(0, "a", 0.03, 1), (0, "b", 0.02, 2), (0, "c", 0.01, 3), (1, "x", 0.5, 1), (2, "p", 0.4, 1), (2, "q", 0.3, 2)]


def test_rerank(spark):
    fused = spark.createDataFrame(CANDIDATES, "query_id long, chunk_id string, rrf_score double, rank int")
    replies = spark.createDataFrame([(0, '[{"index": 1, "score": 9}, {"index": 2, "score": "0.3"}]'), (1, '[{"index": 0, "score": 9}]'), (2, None)], "query_id long, reply string")
    rows = rerank.rerank(fused, replies, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, round(r.rerank_score, 6), r.original_rank, r.rerank_source) for r in rows] == [
        (0, "b", 9.0, 2, "model"), (0, "a", 0.3, 1, "model"), (1, "x", 0.5, 1, "fusion"), (2, "p", 0.4, 1, "fusion"), (2, "q", 0.3, 2, "fusion"),
    ]


def test_triad(spark):
    asked = spark.createDataFrame([(0,), (1,)], "query_id long")
    parts = spark.createDataFrame([(0, "0.4"), (0, "0.8"), (0, None)], "query_id long, reply string")
    both = spark.createDataFrame([(0, '{"score": 0.8}', "1")], "query_id long, grounded_reply string, relevant_reply string")
    rows = triad.rounded(triad.evaluate(asked, parts, both)).orderBy("query_id").collect()
    assert rows[0][1:] == (0.5667, 0.8, 1.0, 0.7889) and rows[1][1:] == (0.5, 0.5, 0.5, 0.5)


def test_prompts(spark):
    rows = spark.createDataFrame([(0, 2, "b", "two\nlines"), (0, 1, "a", "one")], "query_id long, rank int, chunk_id string, text string")
    got = prompts.ordered_texts(rows).select(prompts.answer(F.col("results"), F.lit("why?")), prompts.rerank(F.col("results"), F.lit("why?"))).first()
    assert "[Chunk 1 - ID: a]\none\n\n[Chunk 2 - ID: b]\ntwo\nlines" in got[0] and "[0] one\n[1] two lines" in got[1]
    chat = rows.limit(1).select(prompts.flattened_chat(F.lit("p"), F.expr("array(struct('user' as role, 'hi' as content), struct(cast(null as string) as role, cast(null as string) as content))"), F.lit("sys"))).first()[0]
    assert chat == "sys\n\nuser: hi\n\nuser: \n\np"


def test_pipelines(spark):
    docs = spark.createDataFrame([("d", "Apollo went to the moon.\n\nBread needs flour and water."), ("e", "Gardens need rain.")], "source string, text string")
    asked = spark.createDataFrame([(0, "flour and water"), (1, "the moon")], "query_id long, text string")
    basic = Basic(docs, providers.HashingEmbedder, providers.ExtractiveModel).query(asked, 1)
    assert {r.query_id: r.answer for r in basic.answers.collect()} == {0: "Bread needs flour and water.", 1: "Apollo went to the moon."}
    for backend in ("multi", "single"):
        got = Hybrid(docs, providers.HashingEmbedder, providers.ExtractiveModel, Config(backend=backend)).query(asked)
        assert {r.query_id: r.answer for r in got.answers.collect()}[0] == "Bread needs flour and water."
        assert {tuple(r)[1:] for r in got.triad.collect()} == {(0.5, 0.5, 0.5, 0.5)}
    empty = Basic(docs.limit(0), providers.HashingEmbedder, providers.ExtractiveModel).query(asked)
    assert {r.answer for r in empty.answers.collect()} == {prompts.NO_CONTEXT}


def test_config(monkeypatch):
    monkeypatch.setenv("TOP_K", "7")
    assert Config().top_k == 7 and not flag("No") and flag("yes")
    with pytest.raises(ValueError):
        Config(backend="other")


def test_text_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("one\r\ntwo\rthree é".encode())
    assert [tuple(r) for r in read_text(spark, str(tmp_path / "a b.txt")).collect()] == [("a b.txt", "one\ntwo\nthree é")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_text(spark, str(tmp_path / "none.txt"))


def test_stores(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    assert store.read().count() == 0
    chunks, vectors = spark.createDataFrame([("a",)], "chunk_id string"), spark.createDataFrame([("a", [3.0, 4.0])], "chunk_id string, embedding array<float>")
    store.add(chunks, vectors)
    store.add(chunks, vectors)
    assert [r.norm for r in store.read().collect()] == [5.0]
    with pytest.raises(ValueError):
        store.add(chunks, vectors.limit(0))
    store.clear()
    assert store.read().count() == 0
    multi = VectorStore(spark, str(tmp_path / "m"), MULTI)
    multi.add(chunks, spark.createDataFrame([("a", [[1.0], [2.0]])], "chunk_id string, embeddings array<array<float>>"))
    assert multi.read().count() == 1


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from corpusquery.plans import cli

    monkeypatch.setenv("GRAPH_WORKING_DIR", str(tmp_path / "graph"))
    (tmp_path / "k.txt").write_text("Apollo went to the Moon.\n\nBread needs flour.")
    for kind in ("basic", "hybrid", "graph"):
        cli.main([kind, "--data", str(tmp_path / "k.txt"), "--query", "What does Bread need?", "--debug"])
    out = capsys.readouterr().out
    assert out.count("Bread needs flour.") >= 3 and out.count("2 chunks of 1 documents indexed") == 3 and "BM25L: " in out


def test_stream(spark, tmp_path):
    from corpusquery.operators import sparse
    from corpusquery.streaming.reindex import start

    (tmp_path / "in").mkdir()
    docs = spark.createDataFrame([("d", "red apples\n\ngreen pears")], "source string, text string")
    docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = start(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        stream.processAllAvailable()
        docs.withColumn("source", F.lit("e")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.processAllAvailable()
    finally:
        stream.stop()
    ix = sparse.SparseIndex.read(spark, str(tmp_path / "out/index"))
    assert ix.stats.first().n == 4 and {r.df for r in ix.terms.collect()} == {2}


def test_keys_and_dimensions():
    assert not any(map(providers.usable_key, (None, "", "  ", "your_key_here"))) and providers.require_key(" k ", "KEY") == "k"
    with pytest.raises(ValueError):
        providers.require_key("", "KEY")
    with pytest.raises(ValueError):
        providers.checked_dimension([[1.0], [1.0, 2.0]], 1)


def test_graph_tables(spark, tmp_path):
    from corpusquery.operators import graph

    chunks = spark.createDataFrame([("c1", "Alpha met Beta")], "chunk_id string, text string")
    g = graph.extract(chunks).write(str(tmp_path / "g"))
    assert {r.name for r in g.entities.collect()} == {"alpha", "beta"} and g.relations.count() == 1


def diced(log):
    """A model that answers and rates differently each time, and writes down each prompt."""

    class Diced:
        def complete(self, prompts):
            import random

            dice, out = random.SystemRandom(), []
            for p in prompts:
                kind = "rerank" if "JSON array" in p else "passage" if "Passage: " in p else "grounded" if "Context: " in p else "relevant" if '"score": <' in p else "answer"
                reply = '[{"index": 1, "score": %f}]' % dice.random() if kind == "rerank" else "answer %d" % dice.getrandbits(40) if kind == "answer" else '{"score": %f}' % dice.random()
                with open(log, "a") as f:
                    f.write(repr((kind, p, reply)) + "\n")
                out.append(reply)
            return out

    return Diced


def test_models_are_asked_once(spark, tmp_path):
    import ast

    docs = spark.createDataFrame([("d", "\n\n".join(f"Fact {i} about the moon and the sea." for i in range(9)))], "source string, text string")
    asked = spark.createDataFrame([(0, "the moon"), (1, "the sea and fact")], "query_id long, text string")
    log = str(tmp_path / "log")
    got = Hybrid(docs, providers.HashingEmbedder, diced(log), Config(backend="single")).query(asked)
    shown = {r.query_id: (r.answer, r.prompt) for r in got.answers.collect()}
    scores = {r.query_id: r for r in got.triad.collect()}
    assert {r.query_id: r.answer for r in got.answers.collect()} == {q: a for q, (a, _) in shown.items()} and {r.query_id: r for r in got.triad.collect()} == scores
    calls = [ast.literal_eval(x) for x in open(log)]
    kinds = [k for k, *_ in calls]
    assert {k: kinds.count(k) for k in set(kinds)} == {"rerank": 2, "answer": 2, "passage": 6, "grounded": 2, "relevant": 2}
    for q, (answer, prompt) in shown.items():
        assert (prompt, answer) in [(p, r) for k, p, r in calls if k == "answer"]
        judged = [parse_score(r) for k, p, r in calls if k == "grounded" and f"Answer: {answer}\n" in p]
        assert judged == [pytest.approx(scores[q].groundedness)]


def test_factories_of_one_name(spark):
    class Says:
        def __init__(self, word):
            self.word = word

        def complete(self, prompts):
            return [self.word] * len(prompts)

    make = lambda word: lambda: Says(word)
    rows = spark.createDataFrame([("x",), (None,)], "t string")
    got = rows.select(providers.completed(F.col("t"), make("one")).alias("a"), providers.completed(F.col("t"), make("two")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("one", "two"), (None, None)]


def test_stores_refuse_what_does_not_match(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    vectors = lambda rows: spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    with pytest.raises(ValueError, match="match"):
        store.add(three, vectors([("a", [1.0]), ("x", [1.0]), ("y", [1.0])]))
    with pytest.raises(ValueError, match="dimensions"):
        store.add(three, vectors([("a", [1.0]), ("b", [1.0, 2.0]), ("c", [1.0])]))
    assert store.read().count() == 0
    store.add(three, vectors([(i, [1.0, 0.0]) for i in "abc"]))
    with pytest.raises(ValueError, match="dimensions"):
        store.add(three.limit(1), vectors([("a", [1.0])]))
    store.add(three.filter("chunk_id = 'b'"), vectors([("b", [0.0, 2.0])]))
    assert {r.chunk_id: r.norm for r in store.read().collect()} == {"a": 1.0, "b": 2.0, "c": 1.0}


def test_remote_models(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from corpusquery import remote

    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if body.get("input"):
                reply = {"data": [{"index": i, "embedding": [len(t), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif "fail" in body["messages"][0]["content"]:
                self.send_response(400)
                self.end_headers()
                return
            else:
                reply = {"choices": [{"message": {"content": " part one"}}, {"message": {"content": " and two "}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        embedder = remote.HttpEmbedder(url, "k", "e", 2, batch=2, wait=0.01)
        assert embedder.embed(["a", "bb", "ccc"]) == [[1, 1.0], [2, 1.0], [3, 1.0]] and len(seen) == 3 and seen[0][1] == "Bearer k" and seen[0][2]["model"] == "e"
        with pytest.raises(ValueError):
            remote.HttpEmbedder(url, "k", "e", 3).embed(["a"])
        assert remote.HttpModel(url, "k", "m").complete(["x", "fail"]) == ["part one and two", None]
        for key in ("", "your_key"):
            with pytest.raises(ValueError):
                remote.HttpModel(url, key, "m")
        config = Config(model_url=url, model_key="k", embedding_dim=2, max_tokens=1)
        rows = providers.embedded(spark.createDataFrame([("one two",)], "text string"), config.embedder())
        assert rows.first().embedding == [3.0, 1.0]
    finally:
        server.shutdown()


def test_late_interaction(spark):
    class Local:
        def __init__(self, name, device):
            self.name, self.device = name, device

        def encode(self, kind, inputs):
            return [([[len(kind), len(x)], [0, 0]], [True, False]) for x in inputs]

    made = []
    model = providers.LateInteraction(lambda *a: made.append(a) or Local(*a), "m", "cpu")
    assert not made and model.embed_queries([]) == [] and not made
    assert model.embed_tokens(["ab"]) == [[[8.0, 2.0]]] and model.embed_queries(["ab"]) == [[[5.0, 2.0]]] and made == [("m", "cpu")]
    assert providers.pick_device("mps") == "mps" and providers.pick_device() in ("cpu", "cuda", "mps")
    images = spark.createDataFrame([(bytearray(b"xyz"),), (None,)], "image binary")
    factory = lambda: providers.LateInteraction(lambda *a: Local(*a), "m")
    assert [r.embeddings for r in providers.image_embedded(images, factory).collect()] == [[[5.0, 3.0]], []]
    assert providers.clipped(["a b  c", "a b", ""], 2) == ["a b", "a b", ""]


def test_names_of_the_package():
    import corpusquery

    assert all(getattr(corpusquery, name) is not None for name in corpusquery.__all__) and set(corpusquery.__all__) == set(dir(corpusquery))
    with pytest.raises(AttributeError):
        corpusquery.nothing


def test_extraction_by_a_model(spark, tmp_path):
    from corpusquery.operators import graph

    class Reader:
        def complete(self, prompts):
            good = '```json\n{"entities": [{"name": "Ada", "type": "person", "description": "a writer"}, {"type": "nameless"}], "relations": [{"src": "Engine", "dst": "Ada", "description": "described by", "keywords": ["notes"]}]}\n```'
            return [good if "Ada" in p.rpartition("Text:")[2] else None if "lost" in p else "no JSON" for p in prompts]

    chunks = spark.createDataFrame([("c1", "Ada wrote"), ("c2", "Ada again"), ("c3", "lost"), ("c4", "other")], "chunk_id string, text string")
    g = graph.extract(chunks, lambda: graph.ModelExtractor(Reader())).write(str(tmp_path / "g"))
    assert [tuple(r) for r in g.entities.collect()] == [("ada", "person", "a writer", 2, 2)]
    assert [tuple(r) for r in g.relations.collect()] == [("ada", "engine", "described by", ["notes"], 2, 2)]
    graph.Graph.clear(spark, str(tmp_path / "g"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        graph.Graph.read(spark, str(tmp_path / "g"))


def test_nearest_entities_and_relations(spark):
    from corpusquery.operators import graph

    class Axes:
        words = ("alpha", "beta", "gamma", "delta")

        def embed(self, texts):
            return [[float(t.lower().count(w)) for w in self.words] for t in texts]

    chunks = spark.createDataFrame([("c1", "Alpha met Beta"), ("c2", "Gamma met Delta"), ("c3", "Beta saw Gamma")], "chunk_id string, text string")
    g, asked = graph.extract(chunks), spark.createDataFrame([(0, "alpha alpha")], "query_id long, text string")
    rows = lambda mode, **k: [(r.chunk_id, round(r.score, 6)) for r in graph.search(g, asked, mode, embedder=Axes, **k).orderBy("rank").collect()]
    assert rows("local") == [("c1", 1.5), ("c3", 0.5)]
    half = 2**-0.5
    assert rows("global", near=1) == [("c1", round(half + 2 * 0.5 * half, 6)), ("c3", round(0.5 * half, 6))]
    assert [i for i, _ in rows("hybrid")] == ["c1", "c3"]
