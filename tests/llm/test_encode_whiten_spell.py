"""Exact BPE against the tokenizers library, whitening against numpy's eigenvectors, spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpusquery.llm import backtracking_bpe, registry, spelling, whitening

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def codec():
    return backtracking_bpe.Codec(TOKENIZER)


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
    assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_every_token_and_character(codec, library):
    for text in codec.vocabulary.text[::5]:
        same(codec, library, text.replace("</w>", ""))
    for i in [*range(0x250), *(i for i in range(0x250, 0x20000, 61) if not 0xD800 <= i < 0xE000)]:
        same(codec, library, f"a{chr(i)}b {chr(i)}{chr(i)} {chr(i)}")


def test_random_words(codec, library):
    r = random.Random(1)
    for letters, times, most in (("abcdehilnorst", 4000, 40), ("ab", 500, 300), ("a's <|endoftext|>é\n09.ﬀΣİ漢́", 2000, 60)):
        for _ in range(times):
            same(codec, library, "".join(r.choice(letters) for _ in range(r.randint(0, most))))
    same(codec, library, "one<|endoftext|>two <|startoftext|><|endoftext|><|endoftext")


def test_long_texts_in_pieces(codec, library, monkeypatch):
    text = "".join(random.Random(2).choice("ab é\n\x1c ") for _ in range(20000)) + "x" * 5000
    monkeypatch.setattr(backtracking_bpe, "SEGMENT", 100)
    monkeypatch.setattr(backtracking_bpe, "DECODED", 64)
    assert "".join(backtracking_bpe.segments(text)) == text
    same(codec, library, text)


def test_time_in_proportion_to_length(codec):
    # each position is looked at a bounded number of times, also where every token goes on with every other
    checks = []
    real = codec.vocabulary.goes
    for n in (2000, 20000):
        calls = [0]

        def counted(a, b, calls=calls):
            calls[0] += 1
            return real(a, b)

        codec.vocabulary.goes = counted
        for word in ("a" * n, "ab" * (n // 2), "".join(random.Random(n).choice("aeinrst") for _ in range(n))):
            codec.vocabulary.encode(word)
        checks.append(calls[0])
    codec.vocabulary.goes = real
    assert checks[1] < 15 * checks[0]


def test_words_come_back(codec):
    assert codec.words(codec.encode("Two  Words, é<|endoftext|>x")) == "two words , é <|endoftext|> x"
    assert codec.words(b"") == ""


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        backtracking_bpe.Vocabulary({"model": {"type": "BPE", "unk_token": "x", "vocab": {}, "merges": []}})


def test_encoded_rows(spark, library):
    rows = [(1, None, "u", "v"), (1, "", "u", "v"), (None, "Café 12 it's", "u", "v"), (3, "x y " * 5000, "u", "v"), (4, "a\n<|endoftext|>", "u", "v"), (4, "a\n<|endoftext|>", "u", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = backtracking_bpe.encoded(docs, TOKENIZER, decode=True).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.decoded for r in got) == sorted(library.decode(ids, skip_special_tokens=False) for _, ids in want)
    again = backtracking_bpe.decoded(backtracking_bpe.encoded(docs, TOKENIZER), TOKENIZER).collect()
    assert sorted(r.text for r in again) == sorted(r.decoded for r in got)
    assert backtracking_bpe.encoded(docs.limit(0), TOKENIZER, decode=True).collect() == []


def test_op11_equals_the_library(spark, library):
    docs = pq.read_table(f"{DATA}/documents.parquet")
    want = []
    for i, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, registry.QUERIES["op11_backtracking_bpe"](spark, DATA).collect())) == sorted(want)


# whitening


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_jacobi(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    a = a @ a.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * values[0]) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)


def test_jacobi_small_eigenvalues():
    # a graded matrix: the product of the eigenvalues is known, and the least keeps its digits
    s = np.diag([1e6, 1.0, 1e-6])
    values, _ = whitening.jacobi(s @ (0.1 * np.ones((3, 3)) + np.eye(3)) @ s)
    assert np.isclose(np.prod(values), 1.3, rtol=1e-10)
    assert np.array_equal(whitening.jacobi(np.zeros((3, 3)))[0], np.zeros(3))


def expected(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


def whitened_rows(spark, rows, tmp_path, extra=""):
    d = str(tmp_path / "t")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, x string, component string").write.parquet(f"{d}/embeddings.parquet")
    return whitening.query(spark, d).collect()


def test_op12_equals_numpy(spark, tmp_path):
    r = np.random.default_rng(5)
    vectors = (r.standard_normal((60, 6)) @ r.standard_normal((6, 6))).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:20], np.repeat(vectors[:1], 50, axis=0)])
    rows = [(i, v.tolist(), "a", "b", "c") for i, v in enumerate(vectors)]
    bad = [(200, None), (201, [1.0, None] + [1.0] * 4), (202, [float("nan")] + [1.0] * 5), (203, [float("inf")] + [1.0] * 5), (204, [])]
    got = whitened_rows(spark, rows + [(i, v, "a", "b", "c") for i, v in bad], tmp_path)
    x = np.floor(256 * vectors.astype(float)).astype(int)
    n, deviation, white, share = expected(x)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        column = np.array([by[i, k + 1].whitened for i in range(len(x))])
        assert min(np.abs(column - white[:, k]).max(), np.abs(column + white[:, k]).max()) < 1e-9
        assert abs(by[0, k + 1].explained / share[k] - 1) < 1e-9
        assert all(by[i, k + 1].deviation == deviation[i] for i in range(len(x)))


def test_op12_edges(spark, tmp_path):
    one = whitened_rows(spark, [(None, [0.5, -0.5], "", "", ""), (1, [0.5, -0.5], "", "", "")], tmp_path / "one")
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    assert whitened_rows(spark, [(1, None, "", "", "")], tmp_path / "none") == []
    big = whitened_rows(spark, [(i, [2.0**40 * i, float(i * i)], "", "", "") for i in range(5)] + [(9, [1e30, 1.0], "", "", "")], tmp_path / "big")
    assert {r.vec_id for r in big} == set(range(5)) and big[0].identity_error < 1e-4
    x = [[256 * 2**40 * i, 256 * i * i] for i in range(5)]
    s = [sum(v[j] for v in x) for j in range(2)]
    want = [sum((5 * v[j] - s[j]) ** 2 for j in range(2)) for v in x]
    assert {(r.vec_id, r.deviation) for r in big} == {(i, w if w < 2**63 else None) for i, w in enumerate(want)}
    # with fewer vectors than components the rest have no variance
    two = whitened_rows(spark, [(0, [0.0, 0.0, 0.0], "", "", ""), (1, [1.0, 1.0, 1.0], "", "", "")], tmp_path / "two")
    assert sorted((r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in two) == [(1, 1.0), (1, 1.0), (2, None), (2, None), (3, None), (3, None)]
    with pytest.raises(Exception, match="dimensions"):
        whitened_rows(spark, [(0, [0.0], "", "", ""), (1, [1.0, 1.0], "", "", "")], tmp_path / "mixed")


# spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))


def variants_of(numbers):
    """Near words by their patterns with one place open."""
    patterns = defaultdict(set)
    for w in numbers:
        for i in range(len(w) + 1):
            patterns[w[:i] + "*" + w[i:]].add(w)
            patterns[w[:i] + "*" + w[i + 1 :]].add(w)
    out, form = [], {}
    beside = defaultdict(set)
    for group in patterns.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                beside[a].add(b)
                beside[b].add(a)
    for w in numbers:
        best = min(beside[w], key=lambda o: (-numbers[o], o), default=None)
        if best and numbers[best] >= 2 * numbers[w]:
            form[w] = best
    for w, n in numbers.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(beside[w]), numbers.get(form.get(w))))
    return sorted(out, key=str)


def counted(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("q", [2, 3])
def test_candidates_lose_no_near_word(q):
    r = random.Random(q)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(400)})
    index = spelling.Index(q)
    for w in words:
        index.add(w)
    kept = total = 0
    for w in words:
        for more in (0, 1):
            got = {index.words[p] for p in index.candidates(w, index.grams(w), more)}
            assert {o for o in words if len(o) == len(w) + more and spelling.one_edit(w, o)} <= got
            kept, total = kept + len(got), total + len(words)
    assert kept < total / 4


@pytest.mark.parametrize("hot", [False, True])
def test_variants_equal_brute_force(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(spelling, "MOST_WORDS", 15)
        monkeypatch.setattr(spelling, "SHARD_WORDS", 40)
    r = random.Random(7)
    words = {"".join(r.choice("abcdé") for _ in range(r.randint(5, 8))) for _ in range(150)} | {"prefix" + "".join(r.choice("abc") for _ in range(4)) for _ in range(60)} | {"x" * 3000, "x" * 2999 + "y", "x" * 3001}
    for w in list(words)[:150]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1 :]}
    numbers = {w: r.choice([3, 3, 4, 6, 12, 24, 50]) for w in sorted(words) if len(w) >= 5}
    got = spelling.variants(spark.createDataFrame(list(numbers.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_of(numbers)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(f and f != root for _, f, root, *_ in want)


def test_op13_equals_brute_force(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet")
    numbers = counted(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))
    got = sorted(map(tuple, registry.QUERIES["op13_spelling_variants"](spark, DATA).collect()), key=str)
    assert got == variants_of(numbers) and len(got) > 1000


def test_words_of_odd_rows(spark, monkeypatch):
    rows = [(None, "Straße ÀÉÎabc straße " * 3), (1, None), (2, ""), (3, "abcdefg " * 50), (3, "abcdefg " * 50), (4, "a1b2 \x00×÷×÷× x_abcdef")]
    docs = spark.createDataFrame([(*x, "u", 1) for x in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.counts(docs).collect()} == counted(rows)
    monkeypatch.setattr(spelling, "SEGMENT", 64)
    pieces = list(spelling._runs("Abcde fghij " * 200))
    assert len(pieces) > 1 and [w for p in pieces for w in p] == ["abcde", "fghij"] * 200
    assert spelling.variants(spelling.counts(docs.limit(0))).collect() == []
    assert spelling.slipped(None, "word") in ("word", "ord", "wrd", "wod", "wor")
