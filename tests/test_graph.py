"""The graph: one pass over texts, descriptions of any number, keywords of two levels, answers under a budget, documents added and taken out; the ledger of replies."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusquery import providers
from corpusquery.operators import answers, graph
from corpusquery.operators.chunking import chunk
from corpusquery.plans.config import Config
from corpusquery.plans.pipelines import Hybrid
from corpusquery.sources.graph_store import GraphStore
from corpusquery.sources.replies import Replies
from corpusquery.sources.textfile import read_text

# workers don't have this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tables(g):
    return [sorted(str(tuple(r)) for r in getattr(g, n).collect()) for n in graph.TABLES]


def test_texts_are_gone_through_once(spark, monkeypatch):
    plans, real = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    chunks = spark.createDataFrame([(f"c{i}", "Alpha met Beta-7 and Gamma") for i in range(5)], "chunk_id string, text string")
    graph.extract(chunks).kept()
    assert sum(p.count("regexp_extract_all") for _, p in plans) == 1
    assert not [p for _, p in plans for line in p.splitlines() if "Filter" in line.split("(")[0] and "regexp" in line]


class Listing:
    """A summariser that joins what it gets, and counts."""

    def __init__(self, log):
        self.log = log

    def summarise(self, groups):
        with open(f"{self.log}/{os.getpid()}", "a") as f:
            f.writelines(f"{len(g)}\n" for g in groups)
        return ["|".join(sorted(x for t in g for x in t.split("|"))) for g in groups]


def test_descriptions_of_any_number(spark, tmp_path):
    log = str(tmp_path)
    hub = [("hub", f"d{i:05d}") for i in range(10_000)]
    rows = spark.createDataFrame([*hub, *hub, ("one", "x"), ("two", "a"), ("two", "b"), ("none", "")], "name string, description string")
    got = {r.name: r.description for r in graph.merged_descriptions(rows, ["name"], lambda: Listing(log)).collect()}
    assert set(got) == {"hub", "one", "two"} and got["one"] == "x" and got["two"] == "a|b"
    assert got["hub"].split("|") == [d for _, d in hub]
    sizes = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert len(sizes) > 700 and max(sizes) < 3 * graph.GROUP
    plain = {r.name: r.description for r in graph.merged_descriptions(rows, ["name"]).collect()}
    assert sorted(plain["hub"].split("; ")) == [d for _, d in hub] and plain["two"] == "a; b"


class Reader:
    """Entities by capital letters, with a description by text; a model's reply as JSON."""

    def __init__(self, log):
        self.log = log

    def complete(self, prompts):
        with open(f"{self.log}/{os.getpid()}", "a") as f:
            f.writelines("x\n" for _ in prompts)
        out = []
        for p in prompts:
            words = [w.strip(".") for w in p.rpartition("Text:\n")[2].split()]
            names = [w for w in words if w[:1].isupper()]
            nodes = [{"name": n, "type": "thing", "description": f"{n} of {len(words)} words"} for n in names]
            edges = [{"src": a, "dst": b, "description": "beside", "keywords": [w for w in words if w.islower()]} for a, b in zip(names, names[1:])]
            out.append(json.dumps({"entities": nodes, "relations": edges}))
        return out


def test_documents_added_in_parts_equal_all_at_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"Ada met Bob and Cy{i % 3} by chance {'again ' * i}.\n\nEve saw Ada") for i in range(9)], "source string, text string")
    (tmp_path / "log").mkdir()
    log = str(tmp_path / "log")
    reader = lambda: graph.ModelExtractor(Reader(log))
    calls = lambda: sum(len(p.read_text().split()) for p in (tmp_path / "log").iterdir())
    whole = graph.extract(chunk(docs, assignments=False).select("chunk_id", "text"), reader)
    want, asked = tables(whole), calls()
    store = GraphStore(spark, str(tmp_path / "g"))
    assert [store.insert(docs.filter(F.expr(f"cast(substr(source, 2) AS int) % 3 = {k}")), reader) for k in range(3)] == [3, 3, 3]
    assert tables(store.graph()) == want and calls() <= 2 * asked
    before = calls()
    assert store.insert(docs, reader) == 0 and calls() == before
    # a changed text replaces the document, and a document that is taken out leaves nothing behind
    changed = docs.withColumn("text", F.when(F.col("source") == "d4", "Zoe met Ada").otherwise(F.col("text"))).filter("source <> 'd7'")
    assert store.insert(changed, reader) == 1 and store.withdraw(spark.createDataFrame([("d7",), ("unknown",)], "source string")) == 1
    left = tables(graph.extract(chunk(changed, assignments=False).select("chunk_id", "text"), reader))
    assert tables(store.graph()) == left != want
    store.compact()
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.endswith(".done")]) == 1
    assert tables(GraphStore(spark, str(tmp_path / "g")).graph()) == left and store.insert(changed, reader) == 0 and store.chunks().count() == 15
    with pytest.raises(ValueError):
        store.insert(docs.union(docs))
    store.clear()
    assert store.graph().entities.count() == 0


class Axes:
    words = ("alpha", "beta", "gamma", "delta", "journey")

    def embed(self, texts):
        return [[float(t.lower().count(w)) for w in self.words] for t in texts]


class Levels:
    def keywords(self, texts):
        return graph.ModelKeywords(self).keywords(texts)

    def complete(self, prompts):
        return ['{"low": ["alpha"], "high": ["gamma", "delta"]}' if "known" in p.rpartition("Question:")[2] else "no JSON" for p in prompts]


def test_keywords_of_two_levels(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "Alpha met Beta"), ("c2", "Gamma met Delta"), ("c3", "Beta saw Journey")], "chunk_id string, text string")
    g = graph.extract(chunks).embedded(Axes).write(str(tmp_path / "g"))
    assert g.entity_vectors.count() == 5 and g.relation_vectors.count() == 3
    asked = spark.createDataFrame([(0, "known"), (1, "Where did Alpha-9 go by a journey?")], "query_id long, text string")
    levels = graph.levels(asked, Levels)
    assert {r.query_id: (r.low, r.high) for r in levels.collect()} == {0: ("alpha", "gamma delta"), 1: (asked.collect()[1].text,) * 2}
    # without a model: names, and the tokens that aren't in one
    assert {r.query_id: (r.low, r.high) for r in graph.levels(asked).collect()} == {0: ("known", "known"), 1: ("where alpha-9", "did go by a journey")}
    got = graph.search(g, asked.filter("query_id = 0"), "hybrid", 5, embedder=Axes, near=1, digits=6, keywords=levels).collect()
    # entity alpha at its chunk and half of it at beta's; relation delta-gamma at its chunk, and half of its ends there
    assert sorted((r.chunk_id, r.score) for r in got) == [("c1", 1.5), ("c2", 2.0), ("c3", 0.5)]

    def never(*_):
        raise AssertionError("vectors are stored")

    assert graph._vectored(g, never) is g


def test_answers_within_a_budget(spark):
    long = "Gamma " + "word " * 50
    chunks = spark.createDataFrame([("c1", "Alpha met Beta"), ("c2", long), ("c3", "Beta saw Gamma")], "chunk_id string, text string")
    g, asked = graph.extract(chunks), spark.createDataFrame([(0, "What of Beta?"), (1, "nothing here"), (2, None)], "query_id long, text string")
    got = {r.query_id: r for r in answers.answered(answers.contexts(g, asked, chunks, budget=answers.Budget(4, 100, 10, 10)), providers.ExtractiveModel).collect()}
    assert got[0].entities == "beta (word)\ngamma (word)" and got[0].n_entities == 2 and got[0].n_relations == 2 and got[0].relations.startswith("alpha -- beta (alpha, beta)")
    # passages: whole or not at all, from the first on
    assert got[0].n_passages == 2 and long not in got[0].prompt and got[0].answer in ("Alpha met Beta", "Beta saw Gamma")
    assert all((got[i].n_entities, got[i].prompt, got[i].answer) == (0, None, answers.NO_CONTEXT) for i in (1, 2))
    with pytest.raises(ValueError):
        answers.contexts(g, asked, chunks, "naive")


class Counting:
    """Answers in capitals; writes down what it is asked, fails once at a prompt of that name, and has no reply to another."""

    def __init__(self, log):
        self.log = log

    def complete(self, prompts):
        for p in prompts:
            with open(f"{self.log}/asked-{os.getpid()}", "a") as f:
                f.write(p + "\n")
            if p == "fail" and not os.path.exists(f"{self.log}/failed"):
                open(f"{self.log}/failed", "w").close()
                raise RuntimeError("lost")
        return [None if p == "mute" else p.upper() for p in prompts]


def test_a_prompt_is_asked_about_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = str(tmp_path / "log")
    model = lambda: Counting(log)
    asked = lambda: sorted(x for p in (tmp_path / "log").glob("asked-*") for x in p.read_text().split())
    ledger = Replies(spark, str(tmp_path / "r"), part=4)
    rows = spark.createDataFrame([(i, f"p{i % 12}") for i in range(40)] + [(90, None), (91, "mute")], "id long, prompt string")
    got = {r.id: r.said for r in ledger.told(rows, F.col("prompt"), model, "m", "said").collect()}
    assert len(got) == 42 and all(got[i] == f"P{i % 12}" for i in range(40)) and got[90] is got[91] is None
    assert asked() == sorted([f"p{i}" for i in range(12)] + ["mute"])
    # again: only what has no reply; another model is another matter
    assert ledger.ask(rows, model, "m") == 1 and ledger.ask(rows.filter("id < 3"), model, "other") == 3
    assert ledger.read().count() == 15
    # a run that fails keeps the parts that were whole, and the next one asks for the rest
    more = spark.createDataFrame([(i, f"q{i}") for i in range(20)] + [(20, "fail")], "id long, prompt string")
    with pytest.raises(Exception, match="lost"):
        ledger.ask(more, model, "m")
    kept, before = ledger.read().filter("prompt LIKE 'q%'").count(), len(asked())
    assert ledger.ask(more, model, "m") == 21 - kept and len(asked()) - before == 21 - kept
    assert ledger.read().filter("model = 'm'").count() == 12 + 21
    ledger.clear()
    assert ledger.read().count() == 0


def test_pipelines_use_the_ledger(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = str(tmp_path / "log")
    docs = spark.createDataFrame([("d", "red apples\n\ngreen pears\n\nblue plums")], "source string, text string")
    asked = spark.createDataFrame([(0, "red pears"), (1, "red pears")], "query_id long, text string")
    config = Config(backend="single", reply_dir=str(tmp_path / "r"))
    said = []
    for _ in range(2):
        got = Hybrid(docs, providers.LetterEmbedder, lambda: Counting(log), config).query(asked)
        said.append(sorted(map(str, got.answers.select("query_id", "answer").collect())))
        got.triad.collect()
        prompts = [x for p in (tmp_path / "log").glob("asked-*") for x in p.read_text().split("\n")]
        said.append(len(prompts))
    assert said[0] == said[2] and said[1] == said[3]


def test_a_model_that_reads():
    model = providers.OverlapModel()
    from corpusquery.operators import prompts as P

    rerank = P._RERANK % ("red pears", "[0] Red apples\n[1] no [2] fruit\n[2] pears, red")
    relevance = P._CONTEXT_RELEVANCE % ("red pears now", "Red apples")
    grounded = P._GROUNDEDNESS % ("red apples", "apples are red")
    direct = P._ANSWER_RELEVANCE % ("!", "red")
    got = model.complete([rerank, relevance, grounded, direct])
    assert json.loads(got[0]) == [{"index": 0, "score": 5.0}, {"index": 1, "score": 0.0}, {"index": 2, "score": 10.0}]
    assert [json.loads(x)["score"] for x in got[1:]] == [0.33, 0.66, 0.0]


def test_a_named_local_model_needs_a_loader():
    with pytest.raises(ValueError, match="nothing loads it"):
        Config(multi_model="some-model").multi_embedder()
    assert Config(multi_model="some-model", multi_load=lambda name, device: None).multi_embedder()().name == "some-model"


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes("a\r\nb\rÉ".encode())
    assert read_text(spark, str(tmp_path / "good.txt")).first().text == "a\nb\nÉ"
    (tmp_path / "bad.txt").write_bytes(b"a \xe9 b")
    with pytest.raises(Exception, match="INVALID_UTF8|UTF-8|UTF8"):
        read_text(spark, str(tmp_path / "bad.txt")).collect()
