import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusquery.llm.exchange import shard_slices, tally
from corpusquery.llm.kernels import ALNUM, NON_SPACE, U64, doc_words, ngrams, pack, segments, text_buffers, unpack, word_spans
from corpusquery.llm.tokens import Encoder

TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aB \n\té-", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    for classes, pattern in ((NON_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[0-9A-Za-z\x80-\xff]+")):
        starts, ends, first = word_spans(data, offsets, classes)
        got = [[bytes(data[a:b]) for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
        assert got == [re.findall(pattern, (t or "").encode()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_hashes_tell_words_apart(texts):
    words, hashes = [], []
    for a, found, first in doc_words(pa.array(texts, pa.string())):
        hashes += found.tolist()
    for t in texts:
        words += [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))


def test_ngrams():
    words = np.arange(1, 8, dtype=U64)
    hashes, at = ngrams(words, np.array([0, 0, 1, 3, 7]), 3)
    assert at.tolist() == [0, 0, 1, 2, 4] and len(set(hashes.tolist())) == 4
    again, _ = ngrams(words[3:], np.array([0, 4]), 3)
    assert again.tolist() == hashes[2:].tolist()


def test_segments_and_slices():
    assert list(segments(np.array([0, 3, 6, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert text_buffers(pa.chunked_array([pa.array(["ab", "c"]).slice(1), pa.array(["d"])]))[0].tobytes() == b"cd"


def test_packing():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**64, 100, dtype=U64))
    n = rng.integers(0, 2**32, 50).astype(np.uint32)
    assert (unpack(pack(x), U64) == x).all() and (unpack(pack(n), np.uint32) == n).all() and pack(x[:0]) == b""
    cuts = shard_slices(x, 7)
    assert cuts[0] == 0 and cuts[-1] == len(x) and (np.diff(cuts) >= 0).all()
    found, (count,) = tally(np.array([3, 1, 3], U64))
    assert found.tolist() == [1, 3] and count.tolist() == [1, 2]


def test_words_round_apostrophes_are_cut_as_by_the_library():
    import public_tokenizers

    encoder = Encoder.get(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "a", "Ab", "é", "9", "²", "s'", ".", "|", "\x85", "'S"]
    texts = [f"{a}{b}{c}" for a in parts for b in parts for c in parts]
    assert encoder.encode(texts) == encoder._whole(texts)
