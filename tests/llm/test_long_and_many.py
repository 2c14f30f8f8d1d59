"""Very long texts, very many classes, the license scan's base columns, and the pipeline against each stage row by row."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusquery.llm import decontaminate, language, license_scan, quotes, sampled_pieces, toxicity

DATA = "/root/testdata/sf0.001"


def test_a_megabyte_of_quote_marks(spark):
    deep = "> " * 300_000 + "Deep"
    rows = [(0, 0, "u", "Deep"), (0, 1, "a", deep), (0, 2, "u", ">" * 1_000_000), (0, 3, "a", "> \\t>> x\\n >\\t\\n>")]
    got = {r.turn: r for r in quotes.threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_quoted, got[1].n_linked, got[1].body) == (1, 1, "") and (got[2].n_quoted, got[3].n_quoted) == (0, 1)


def test_tiles_of_long_equal_words():
    # what stands in the item once is a tile once, however often the text has it
    same = np.full(200_000, 7, np.uint64)
    assert decontaminate.tiles(same, np.full(50, 7, np.uint64)) == [(0, 0, 50)]
    item = np.full(60, 7, np.uint64)
    item[30] = 9
    assert decontaminate.tiles(same, item) == [(0, 0, 30), (30, 31, 29)]
    mixed = np.array([random.Random(3).randrange(2) for _ in range(100_000)], np.uint64)
    got = decontaminate.tiles(mixed, mixed[500:560])
    assert got[0][1:] == (0, 60) and (mixed[got[0][0] : got[0][0] + 60] == mixed[500:560]).all()


def test_more_than_a_thousand_languages(spark):
    langs = [f"l{k:04d}" for k in range(1100)]
    docs = spark.createDataFrame([(k, f"text {x} of its own {x}", x) for k, x in enumerate(langs)], "doc_id long, text string, lang string")
    model = language.train(docs, per_lang=1, slices=1, steps=1)
    assert model.langs == langs
    out = language.predict(docs.limit(30), model).collect()
    assert len(out) == 30 and all(r.lang_pred in langs and 0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("prior", [0.5, 0.97, 1.0])
def test_any_prior(prior):
    rng = np.random.default_rng(1)
    rows = lambda own: [np.unique(np.concatenate((rng.integers(0, 500, 20), own))).astype(np.int32) for _ in range(60)]
    positive, unlabelled = rows([600, 601]), rows([700])
    model = toxicity.fit(positive, unlabelled, prior, steps=50)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias) and model.weights[600] > 0


def test_all_overlapping_notices_are_compared(monkeypatch):
    # one long notice of a label over many short ones of another, nearer ones: it has to go, however many there are
    words = [f"w{k}" for k in range(40)]
    notices = [("long", " ".join(words), 2, ())] + [("short", " ".join(words[k : k + 2]), 0, ()) for k in range(0, 40, 2)]
    text = " ".join(w if k != 39 else "w3" for k, w in enumerate(words)).encode()
    found = license_scan.Scanner({}, notices).spans(text)
    assert {x[0] for x in found} == {"short"} and len(found) == 19
    # the other way round: an exact long one stays, and all that lie in it go
    exact = license_scan.Scanner({}, [("long", " ".join(words), 2, ())] + [("short", " ".join(words[k : k + 3]), 1, ()) for k in range(0, 36, 3)])
    assert [x[0] for x in exact.spans(" ".join(w if k % 3 else w[:-1] + "x" for k, w in enumerate(words)).encode())].count("short") >= 1
    assert [x[0] for x in exact.spans(" ".join(words).encode())] == ["long"]


def test_long_stretches_have_the_same_spans_on_both_sides_of_the_switch(monkeypatch):
    r, scanner = random.Random(9), license_scan.Scanner()
    notices = [n[1] for n in license_scan.NOTICES]
    for trial in range(40):
        parts = []
        for _ in range(r.randint(1, 60)):
            words = r.choice(notices).split()
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(words))
                words[k] = r.choice([words[k][1:] or "a", words[k] + "x", words[k][:-1] + "q", "of"])
            parts.append(" ".join(words if r.random() < 0.7 else words[: len(words) // 2]))
        text = " ".join(parts).encode()
        got = []
        for size in (0, 1024, 1 << 30):
            monkeypatch.setattr(license_scan, "LONG", size)
            got.append(scanner.spans(text))
        assert got[0] == got[1] == got[2], trial


def test_base_columns_against_sql_over_a_whole_table(spark):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    con = duckdb.connect()
    con.execute("create table t as select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from '/root/testdata/sf0.01/documents.parquet'")
    hits = " union all ".join(
        f"select doc_id, i, '{label}' as label from (select doc_id, ws, unnest(range(len(ws))) as i from t) where " + " and ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in phrases.items()
    )
    want = con.execute(f"with h as ({hits}), g as (select doc_id, count(*) n, min(i) a, max(i) b, string_agg(distinct label, ',' order by label) l from h group by 1) select t.doc_id, len(ws), coalesce(n, 0), a, b, coalesce(l, '') from t left join g using (doc_id)").fetchall()
    got = license_scan.query(spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(x[2] > 0 for x in want) > 5


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_pipeline_stage_by_stage(spark):
    """What each stage keeps, decided document by document in plain Python, with the models that the stages train."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    frame = lambda: spark.createDataFrame(list(kept.values()), docs.schema)
    ids = lambda k: {r.doc_id for r in corpus_pipeline.STAGES[k][1](spark, frame(), DATA).collect()}

    model, left = language._trained(frame()), {}
    for i, r in kept.items():
        raw = (r.text or "").encode()
        prob = model.documents(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        if any(c.isalpha() for c in r.text or "") and min(1.0, prob.max()) >= language.LEAST_SHARE / len(model.langs):
            left[i] = r
    assert ids(0) == set(left)
    kept = left

    model, left = toxicity._trained(frame(), spark.read.parquet(f"{DATA}/labels.parquet")), {}
    for i, r in kept.items():
        numbers = next(toxicity.features(pa.array([r.text])))[1]
        if model.bias + sum(float(model.weights[k]) for k in set(numbers.tolist())) < 0:
            left[i] = r
    assert ids(1) == set(left)
    kept = left

    sets = {}
    for i, r in kept.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in kept}
    order = sorted(kept)
    for _ in range(4):
        for x in order:
            for y in order:
                if x < y and group[x] != group[y] and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    group[x] = group[y] = min(group[x], group[y])
    left = {i: r for i, r in kept.items() if group[i] == i}
    assert ids(2) == set(left) and len(left) < len(kept)
    kept = left

    items = [words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left, codes = {}, {}
    coded = lambda words: np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64)
    items = [coded(x) for x in items if x]
    for i, r in kept.items():
        text = coded(words_of(r.text))
        if not any(2 * sum(k for *_, k in decontaminate.tiles(text, x)) >= len(x) for x in items):
            left[i] = r
    assert ids(3) == set(left) and len(left) < len(kept)
    kept = left

    v = sampled_pieces.Vocabulary.get(sampled_pieces._model())
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(kept)
    for r in rows:
        alone = sampled_pieces.Lattices(v).segment([kept[r.doc_id].text], sampled_pieces._numbers_of([r.doc_id]))[0]
        assert list(r.ids) == alone.tolist() and v.decode(list(r.ids)) == kept[r.doc_id].text and r.n_pieces == len(r.ids)
