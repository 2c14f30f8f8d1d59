"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed features (words, and the first four and five bytes of longer words) is trained in numpy from
confirmed toxic texts and unlabelled ones. With class prior p, loss l, positives P and unlabelled U, the risk is

    p * mean_P l(+f) + max(0, mean_U l(-f) - p * mean_P l(-f))

(Kiryo et al. 2017): the bracket is an unbiased estimate of the negatives' risk, and where the fit drives it below
zero, its gradient is followed upwards instead.

Only features whose share among the positives differs from that among the unlabelled by Z_CUT standard errors get a weight:
the sum of very many weights near zero would drown the evidence of one word in a long text.

The prior is the toxic share of the training labels, whatever it is. Both samples are bounded (POSITIVES, UNLABELLED: the rows of the
smallest id hashes), and so is the model (2 ** BITS weights): it is what tasks are sent. Scoring reads whole texts.

A text without a word, null or empty, gets the score of the bias alone. Without any positive, all scores are 0. Texts of
equal features have equal scores, whatever their ids. Rows without an id are scored and never learned from; repeated rows
are scored alike, and one row of an id is learned from. Other columns are kept or ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import crc_fold, read
from .kernels import ALNUM, U64, lean, mix, segments, text_buffers, word_hashes, word_spans

BITS = 18
POSITIVES, UNLABELLED = 2000, 6000
STEPS, RATE, DECAY = 400, 0.05, 1e-6
Z_CUT, LEAST = 5.0, 4
FOLDS = 5
#: A score from which a document counts as toxic.
CUT = 0.5


def features(column, keep: np.ndarray | None = None):
    """(first row, feature numbers, first of each row with the total at the end); a row's features are distinct. keep: flags of the features to return."""
    data, offsets = text_buffers(column)
    for a, b in segments(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], ALNUM)
        rows = np.repeat(np.arange(b - a), np.diff(first))
        found = [(rows, word_hashes(part, starts, ends))]
        for k in (4, 5):
            long = ends - starts > k
            found.append((rows[long], mix(word_hashes(part, starts[long], starts[long] + k) + U64(k))))
        found = [(r, h >> U64(64 - BITS)) for r, h in found]
        if keep is not None:
            found = [(r[k], h[k]) for r, h in found for k in [np.flatnonzero(keep[h])]]
        keys = np.unique(np.concatenate([(r.astype(U64) << U64(BITS)) | h for r, h in found]))
        yield a, (keys & U64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(b - a + 1).astype(U64) << U64(BITS))


def _margins(weights: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[numbers], dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]


class Model:
    """weights and bias; score is the sigmoid of bias + the sum of a text's weights."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, column) -> np.ndarray:
        out = np.zeros(len(column))
        for a, numbers, at in features(column, self.weights != 0):
            out[a : a + len(at) - 1] = _margins(self.weights, numbers, at)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -60, 60)))


@dataclass
class Rows:
    """Feature numbers of texts that lie one after the other, and where each begins."""

    numbers: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Rows:
        return Rows(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def risk(w: np.ndarray, b: float, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, bracket, slopes by weights and bias to step down along): those of the whole risk, or where the bracket is below zero those of the bracket turned round."""
    fp, fu = (_margins(w, x.numbers, x.at) + b for x in (positive, unlabelled))
    gain = prior * np.logaddexp(0, -fp).mean()
    bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gp, gu = prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    slopes = np.concatenate((-prior * _sigmoid(-fp) / len(fp) - gp, gu) if bracket >= 0 else (gp, -gu))
    each = np.repeat(slopes, np.concatenate((np.diff(positive.at), np.diff(unlabelled.at))))
    by_weight = np.bincount(np.concatenate((positive.numbers, unlabelled.numbers)), each, minlength=len(w))
    return float(gain), float(bracket), np.append(by_weight, slopes.sum())


def selected(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Numbers of the features that tell the samples apart: found in LEAST texts of the two samples at least, and Z_CUT standard errors from an even share."""
    p, u = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    even = (p + u + 0.5) / (n + m + 1)
    z = (p / n - u / m) / np.sqrt(even * (1 - even) * (1 / n + 1 / m) + 1e-12)
    return np.flatnonzero((np.abs(z) >= Z_CUT) & (p + u >= LEAST))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Model:
    """nnPU with the logistic loss, by Adam on both samples at once: mini-batches would make the bracket negative by chance."""
    size = 1 << BITS
    if not positive or not unlabelled or not prior:
        return Model(np.zeros(size, np.float32), -60.0)
    chosen = selected(positive, unlabelled)
    to = np.full(size, -1, np.int64)
    to[chosen] = np.arange(len(chosen))
    some = [Rows.of([(y := to[x])[y >= 0] for x in rows]) for rows in (positive, unlabelled)]
    size = len(chosen)
    # the descent begins at the prior's odds, or where every label is toxic at a finite bias
    w, b, moments = np.zeros(size), np.log(prior / max(1 - prior, 1e-9)), np.zeros((2, size + 1))
    for step in range(1, steps + 1):
        g = risk(w, b, *some, prior)[2]
        g[:-1] += DECAY * w
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w
    return Model(weights, float(b))


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """Features of the documents whose ids have the smallest hashes, ``most`` at most. Of the rows of one id, the one whose text has the smallest hash."""
    chosen = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    @lean
    def each(batches):
        for batch in batches:
            for a, numbers, at in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(at) - 1), batch.column(2).slice(a, len(at) - 1), pa.array([x.tobytes() for x in np.split(numbers, at[1:-1])], pa.binary())], names=["doc_id", "h", "x"])

    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(each, "doc_id long, h long, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("r")).select("r.x").collect()
    return [np.frombuffer(x, np.int32) for x in sorted(bytes(r[0]) for r in rows)]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): rows of the training fold only. Toxic rows of docs are the positives, any others are unlabelled."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    bad = docs.select("doc_id").join(known.filter("toxic = 1"), "doc_id", "left_semi")
    rest = docs.select("doc_id").filter("doc_id IS NOT NULL")
    return fit(_sample(docs, bad, positives), _sample(docs, rest, unlabelled), (toxic or 0) / max(1, n))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column score, in place of one that they have."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch[text]))], names=[*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    return docs.mapInArrow(each, schema)


def _trained(docs: DataFrame, labels: DataFrame) -> Model:
    mine = F.coalesce(crc_fold(F.col("doc_id"), FOLDS), F.lit(0)) != 0
    return train(docs.select(F.col("doc_id").cast("long"), "text").filter(mine), labels.select("doc_id", "toxic").filter(mine))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, _trained(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut."""
    renamed = docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns))
    return score(renamed, _trained(docs, read(spark, sf_dir, "labels")), "in_text").filter(F.col("score") < CUT).select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
