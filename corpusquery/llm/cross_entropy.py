"""Cross-entropy difference: how much likelier is a document under a target model than under the background.

Both models are bigram models over one shared vocabulary (all distinct words of the corpus). The background is counted on
all documents, the target on those a table names. With c(v w) bigrams inside a document, c(w) words, N all words and V the
vocabulary's size:

    P1(w) = (c(w) + 1) / (N + V)        P(w | v) = (c(v w) + L * P1(w)) / (c(v) + L)

An occurrence of v is followed by a word or by the document's end, so c(v) is the count of v as a left neighbour too; the
first word's left neighbour is a start mark, which is counted as often as there are documents with a word. The end of a
document isn't scored.

The score is the mean over the words of log2 P_background - log2 P_target: negative values are nearer to the target.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z as a-z. Null and empty texts have no words: n_words 0 and
score 0.0. Repeated rows count as often as they stand there; rows of one id are targets together, rows without one never
are. Other columns are ignored, whatever their names. An empty table gives no rows. Without any target document, the target
model is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, n_batches, read, with_batch
from .exchange import counted, tally
from .kernels import NON_SPACE, U64, doc_words, lean, mix, segments, text_buffers, word_spans

#: Weight of the word model inside the bigram model.
LAMBDA = 4.0
_START = U64(0x5851F42D4C957F2D)
_PAIR = U64(0xD6E8FEB86659FD93)


def _heads(first: np.ndarray) -> np.ndarray:
    """Places of the first words."""
    return first[:-1][np.diff(first) > 0]


def _parts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word and of its pair with its left neighbour."""
    left = np.empty_like(words)
    left[1:] = words[:-1]
    left[_heads(first)] = _START
    return words, mix(left * _PAIR + words)


def _vocabulary(docs: DataFrame) -> tuple[int, int]:
    """(distinct words, words): each task sends a distinct word once for each range of rows."""

    @lean
    def each(batches):
        for batch in batches:
            for _, words, _ in doc_words(batch.column(0)):
                found, (n,) = tally(words)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    got = docs.select("text").mapInArrow(each, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).agg(F.count("w"), F.sum("n")).first()
    return int(got[0] or 0), int(got[1] or 0)


def _sizes(docs: DataFrame, targets: DataFrame) -> tuple[int, int, int]:
    """Documents with a word; of the targets, such documents and their words. By ids and counts alone."""

    @lean
    def each(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in segments(offsets):
                first = word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NON_SPACE)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first))], names=["doc_id", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n long").filter("n > 0")
    mine = F.col("mine").isNotNull()
    got = rows.join(targets.withColumn("mine", F.lit(True)), "doc_id", "left").agg(F.count("*"), F.count_if(mine), F.sum(F.when(mine, F.col("n")))).first()
    return tuple(int(x or 0) for x in got)


def score(docs: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", lam: float = LAMBDA, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs scored against the model of those whose id is in ``targets`` (a column doc_id).

    Returns doc_id, n_words, target_bits, background_bits (bits a word under either model) and score, the target's less the background's.
    Texts are shuffled once, into batches, to which the targets' ids come beside them."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    targets = targets.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()
    (v, n_all), (docs_all, docs_target, n_target) = _vocabulary(docs), _sizes(docs, targets)
    n = n_batches(docs, batch_bytes=batch_bytes)

    def items(table: pa.Table, side: pa.Table):
        """Also, for each range of rows: its first row, the first words, and the places of the words and of their pairs among the distinct keys."""
        flags = pa.compute.is_in(table["doc_id"], value_set=side["doc_id"].combine_chunks()).to_numpy()
        ranges, got, of = [], [], []
        for a, words, first in doc_words(table["text"]):
            ranges.append((a, first, len(words)))
            got += _parts(words, first)
            of += [np.repeat(flags[a : a + len(first) - 1], np.diff(first))] * 2
        if not got:
            return np.zeros(0, U64), [np.zeros(0, np.int64)] * 2, []
        found, place = np.unique(np.concatenate(got), return_inverse=True)
        counts = [np.bincount(place, minlength=len(found)), np.bincount(place[np.concatenate(of)], minlength=len(found))]
        cut = np.split(place.astype(np.int32), np.cumsum(np.repeat([n for *_, n in ranges], 2))[:-1])
        return found, counts, [(a, first, cut[2 * k], cut[2 * k + 1]) for k, (a, first, _) in enumerate(ranges)]

    def answer(table: pa.Table, ranges: list, totals: list[np.ndarray]) -> pa.Table:
        n_words = np.zeros(table.num_rows, np.int64)
        bits = np.zeros((2, table.num_rows))
        for a, first, *at in ranges:
            if not len(at[0]):
                continue
            b = a + len(first) - 1
            n_words[a:b] = np.diff(first)
            for m, size, starts in ((0, n_target, docs_target), (1, n_all, docs_all)):
                word, pair = (totals[1 - m][x].astype(np.float64) for x in at)
                left = np.empty_like(word)
                left[1:] = word[:-1]
                left[_heads(first)] = starts
                sums = np.concatenate(([0.0], np.cumsum(-np.log2((pair + lam * (word + 1.0) / (size + v)) / (left + lam)))))
                bits[m, a:b] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
        return pa.table({"doc_id": table["doc_id"], "n_words": n_words, "target_bits": bits[0], "background_bits": bits[1], "score": bits[0] - bits[1]})

    schema = "doc_id long, n_words long, target_bits double, background_bits double, score double"
    return counted(with_batch(docs, n, spare="text"), with_batch(targets, n), items, answer, schema, n, kinds=2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality. Scores to five places."""
    out = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1"))
    return out.select("doc_id", "n_words", *(F.round(c, 5).alias(c) for c in ("target_bits", "background_bits", "score")))


SQL = r"""
WITH w AS (
  SELECT doc_id, i, word, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY i), '') AS prev, good
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, good
        FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
                     doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents))),
one AS (SELECT word, count(*)::DOUBLE AS nb, count(*) FILTER (WHERE good)::DOUBLE AS nt FROM w GROUP BY 1),
ctx AS (SELECT word AS prev, nb, nt FROM one UNION ALL SELECT '', count(*)::DOUBLE, count(*) FILTER (WHERE good)::DOUBLE FROM w WHERE prev = ''),
two AS (SELECT prev, word, count(*)::DOUBLE AS nb, count(*) FILTER (WHERE good)::DOUBLE AS nt FROM w GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS v, sum(nb) AS nb, sum(nt) AS nt FROM one),
s AS (SELECT w.doc_id, count(*) AS n_words,
  avg(-log2((two.nt + 4 * (one.nt + 1) / (n.nt + n.v)) / (ctx.nt + 4))) AS t,
  avg(-log2((two.nb + 4 * (one.nb + 1) / (n.nb + n.v)) / (ctx.nb + 4))) AS b
  FROM w JOIN two ON two.prev = w.prev AND two.word = w.word JOIN one ON one.word = w.word JOIN ctx ON ctx.prev = w.prev, n GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(t, 0.0), 5) AS target_bits, round(coalesce(b, 0.0), 5) AS background_bits,
  round(coalesce(t - b, 0.0), 5) AS score
FROM documents LEFT JOIN s USING (doc_id)
"""
