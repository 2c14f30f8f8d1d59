"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW positions; in each, one gated recurrent unit reads forwards and one
backwards, and a softmax over both states labels every position. A document's probabilities are the mean over all its
positions, so whole texts count and windows of all documents run side by side. The network is trained in numpy by
backpropagation through time on a bounded sample: for each language the PER_LANG documents of the smallest id hashes,
SLICES windows of each. It is of a fixed size, which is what tasks are sent.

A null text or one without a letter is ``und`` with score 0.0. Without labelled rows everything is ``und``. Ties go to the
language that sorts first. Repeated rows are labelled alike, and one row of an id and language is learned from; rows without
an id are labelled and never learned from. Other columns are kept or ignored, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import crc_fold, materialise, read
from .kernels import lean, text_buffers

HIDDEN, WINDOW = 8, 64
PER_LANG, SLICES = 500, 6
STEPS, BATCH, RATE = 300, 192, 0.02
#: Windows that run through the network at once, fewer beyond 16 languages; probabilities of documents that a task holds.
ROWS, HELD = 1024, 1 << 21
FOLDS, HELD_OUT = 4, 2
#: The filter rejects a document whose best language has less than so many times an even share of the probability: one in which no language stands out.
LEAST_SHARE = 1.25
_LETTER = r"\pL"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class BiGru:
    """Parameters by direction d: byte table X (2 * 256, 3H; reset, update, candidate), recurrent U (2, H, 3H) with bias c, and output V (2H, K) with bias o."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(langs)
        self.langs, self.hidden = langs, hidden
        self.p = {
            "X": rng.normal(0, 0.3, (512, 3 * h)).astype(np.float32), "U": rng.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32), "c": np.zeros((2, 1, 3 * h), np.float32),
            "V": rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), "o": np.zeros(k, np.float32),
        }

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """windows (N, T) of bytes -> states (T, 2, N, H): of each position, after it forwards and backwards. keep: gets what the way back needs, by step."""
        n, t = windows.shape
        h = self.hidden
        steps = np.ascontiguousarray(np.stack((windows.T, windows.T[::-1]), 1)).astype(np.int32)
        steps[:, 1] += 256
        out = np.empty((t, 2, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        X, U, c = self.p["X"], self.p["U"], self.p["c"]
        for i in range(t):
            given = X[steps[i]]
            from_state = np.matmul(state, U)
            from_state += c
            gates = _sigmoid(given[..., : 2 * h] + from_state[..., : 2 * h])
            reset, update = gates[..., :h], gates[..., h:]
            new = np.tanh(given[..., 2 * h :] + reset * from_state[..., 2 * h :])
            if keep is not None:
                keep.append((steps[i], state, reset, update, new, from_state[..., 2 * h :]))
            state = new + update * (state - new)
            out[i, 0] = state[0]
            out[t - 1 - i, 1] = state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, N, K): each position's probabilities."""
        h = self.hidden
        x = np.matmul(states[:, 0], self.p["V"][:h]) + np.matmul(states[:, 1], self.p["V"][h:])
        x += self.p["o"]
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def loss(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions within the lengths, and its slopes by backpropagation through time."""
        n, t = windows.shape
        h, keep = self.hidden, []
        states = self.states(windows, keep)
        prob = self.probabilities(states)
        real = (np.arange(t)[:, None] < lengths).astype(np.float32)
        total = real.sum()
        hit = prob[:, np.arange(n), labels]
        value = float(-(np.log(hit + 1e-9) * real).sum() / total)
        d = prob.copy()
        d[:, np.arange(n), labels] -= 1.0
        d *= (real / total)[..., None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = d.sum((0, 1))
        for s in (0, 1):
            g["V"][s * h : (s + 1) * h] = states[:, s].reshape(-1, h).T @ d.reshape(-1, d.shape[-1])
        by_state = np.stack([d @ self.p["V"][s * h : (s + 1) * h].T for s in (0, 1)], 1)
        back = np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            index, before, reset, update, new, pre = keep[i]
            back[0] += by_state[i, 0]
            back[1] += by_state[t - 1 - i, 1]
            dnew = back * (1 - update) * (1 - new * new)
            dupdate = back * (before - new) * update * (1 - update)
            dreset = dnew * pre * reset * (1 - reset)
            dgates = np.concatenate((dreset, dupdate, dnew), -1)
            dstate = np.concatenate((dreset, dupdate, dnew * reset), -1)
            np.add.at(g["X"], index.ravel(), dgates.reshape(-1, 3 * h))
            g["U"] += np.matmul(before.transpose(0, 2, 1), dstate)
            g["c"] += dstate.sum(1, keepdims=True)
            back = back * update + np.matmul(dstate, self.p["U"].transpose(0, 2, 1))
        return value, g

    def fit(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> BiGru:
        """Adam on random batches in which languages are drawn evenly."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(x, max(1, BATCH // len(by))) for x in by])
            _, g = self.loss(windows[at], lengths[at], labels[at])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def labelled(self, windows: np.ndarray) -> np.ndarray:
        """(T, K, N): each position's probabilities, as ``states`` and ``probabilities`` give them, with windows along the last axis so that every operation runs over long rows."""
        n, t = windows.shape
        h = self.hidden
        tables = [np.ascontiguousarray(self.p["X"][256 * d : 256 * (d + 1)].T) for d in (0, 1)]
        U, c = np.ascontiguousarray(self.p["U"].transpose(0, 2, 1)), np.ascontiguousarray(self.p["c"].transpose(0, 2, 1))
        V = np.ascontiguousarray(self.p["V"].T)
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        states = np.empty((t, 2, h, n), np.float32)
        state = np.zeros((2, h, n), np.float32)
        given, pre = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        for i in range(t):
            np.take(tables[0], steps[i], axis=1, out=given[0], mode="clip")
            np.take(tables[1], steps[t - 1 - i], axis=1, out=given[1], mode="clip")
            np.matmul(U, state, out=pre)
            pre += c
            gates = given[:, : 2 * h]
            gates += pre[:, : 2 * h]
            _sigmoid(gates)
            new = pre[:, 2 * h :]
            new *= gates[:, :h]
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:, h:]
            state += new
            states[i, 0] = state[0]
            states[t - 1 - i, 1] = state[1]
        x = np.matmul(V[:, :h], states[:, 0])
        x += np.matmul(V[:, h:], states[:, 1])
        x += self.p["o"][:, None]
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def documents(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, labels: np.ndarray | None = None) -> np.ndarray:
        """(documents, K) mean probabilities of texts that lie in data one after the other; labels: gets each position's label."""
        sizes = np.diff(offsets)
        n = -(-sizes // window)
        rows = np.repeat(np.arange(len(sizes)), n)
        begin = offsets[:-1][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) * window
        length = np.minimum(window, offsets[1:][rows] - begin)
        padded = np.concatenate((data, np.zeros(window, np.uint8)))
        out = np.zeros((len(sizes), len(self.langs)))
        step = np.arange(window)
        size = max(16, ROWS * 16 // max(16, len(self.langs)))
        for a in range(0, len(rows), size):
            at, real = begin[a : a + size], length[a : a + size]
            windows = padded[at[:, None] + step]
            inside = step < real[:, None]
            windows[~inside] = 0
            prob = self.labelled(windows)
            if labels is not None:
                labels[(at[:, None] + step)[inside]] = prob.argmax(1).T[inside]
            np.add.at(out, rows[a : a + size], np.einsum("tkn,nt->nk", prob, inside.astype(np.float32)))
        return out / np.maximum(1, sizes)[:, None]


def _windows(texts: list[tuple[bytes, int]], window: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``slices`` windows of each text, evenly spread over it."""
    rows, lengths, labels = [], [], []
    for raw, label in texts:
        count = -(-len(raw) // window)
        for k in sorted({int(x) for x in np.linspace(0, count - 1, min(slices, count))}) if count else []:
            part = raw[k * window : (k + 1) * window]
            rows.append(np.frombuffer(part.ljust(window, b"\0"), np.uint8))
            lengths.append(len(part))
            labels.append(label)
    return np.array(rows).reshape(-1, window), np.array(lengths), np.array(labels)


def train(docs: DataFrame, per_lang: int = PER_LANG, window: int = WINDOW, slices: int = SLICES, steps: int = STEPS) -> BiGru | None:
    """docs(doc_id, text, lang): rows to learn from. Rows without id, text or language are left out; None where none is left."""
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    # the smallest hashes of each language; a first cut by its count leaves a few times per_lang rows, so that no language meets in one task
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    cuts = materialise(counts.select("lang", F.floor(F.lit((1 << 40) * (3 * per_lang + 50)) / F.col("n")).alias("cut")), "languages")
    order = W.partitionBy("lang").orderBy(place, "doc_id")
    chosen = known.select("doc_id", "lang").join(cuts, "lang").filter(place < F.col("cut")).select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).select("doc_id", "lang")

    @lean
    def each(batches):
        for batch in batches:
            texts, (_, langs, hashes) = batch.column(0).cast(pa.large_binary()).to_pylist(), batch.columns[1:]
            got = [(k, *_windows([(x, 0)], window, slices)[:2]) for k, x in enumerate(texts) if x]
            at = pa.array([k for k, *_ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), langs.take(at), hashes.take(at), pa.array([x.tobytes() for _, x, _ in got], pa.binary()), pa.array([n.tolist() for *_, n in got], pa.list_(pa.int32()))], names=["doc_id", "lang", "h", "windows", "lengths"])

    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("text", "doc_id", "lang", F.xxhash64("text").alias("h"))
    rows = rows.mapInArrow(each, "doc_id long, lang string, h long, windows binary, lengths array<int>")
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct("h", "windows", "lengths")).alias("r")).select("lang", "r.windows", "r.lengths").collect()
    if not rows:
        return None
    rows = sorted((r[0], bytes(r[1]), r[2]) for r in rows)
    langs = sorted({r[0] for r in rows})
    data = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(-1, window) for r in rows])
    labels = np.repeat([langs.index(r[0]) for r in rows], [len(r[2]) for r in rows])
    return BiGru(langs).fit(data, np.concatenate([r[2] for r in rows]), labels, steps)


def predict(docs: DataFrame, model: BiGru | None, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with ``spans`` also lang_spans: runs of bytes of one label (start, end, lang); columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", *["lang_spans"] * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    @lean
    def each(batches):
        model = shared.value
        most = HELD // (len(model.langs) if model else 1)
        for batch in (whole.slice(a, most) for whole in batches for a in range(0, max(1, whole.num_rows), max(1, most))):
            letters = pc.match_substring_regex(batch[text], _LETTER).fill_null(False).to_pylist()
            data, offsets = text_buffers(batch[text])
            labels = np.zeros(len(data), np.int16) if spans else None
            names, scores = [], []
            if model is not None:
                prob = model.documents(data, offsets, labels=labels)
                best = prob.argmax(1)
            for i, letter in enumerate(letters):
                known = letter and model is not None
                names.append(model.langs[best[i]] if known else "und")
                scores.append(min(1.0, float(prob[i, best[i]])) if known else 0.0)
            more = []
            if spans:
                runs = []
                for i, known in enumerate(letters):
                    own = labels[offsets[i] : offsets[i + 1]]
                    cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                    runs.append([{"start": a, "end": b, "lang": model.langs[own[a]]} for a, b in zip(cut, cut[1:])] if known and model is not None else [])
                more = [pa.array(runs, run)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), *more], names=[*batch.schema.names, "lang_pred", "score", *["lang_spans"] * spans])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    if spans:
        schema = schema.add("lang_spans", ArrayType(StructType().add("start", LongType()).add("end", LongType()).add("lang", StringType())))
    return docs.mapInArrow(each, schema)


def _trained(docs: DataFrame) -> BiGru | None:
    fold = F.coalesce(crc_fold(F.col("doc_id"), FOLDS), F.lit(HELD_OUT))
    return train(docs.select(F.col("doc_id").cast("long"), "text", "lang").filter(fold != HELD_OUT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), _trained(docs))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in which a language stands out (LEAST_SHARE); where lang is null, it becomes the predicted one.

    The model learns from the documents that come in; without any labelled one nothing is known, and all stay."""
    model = _trained(docs)
    if model is None:
        return docs
    out = predict(docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns)), model, "in_text")
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("score") >= min(1.0, LEAST_SHARE / len(model.langs))))
    return kept.select(*((F.coalesce("in_lang", "lang_pred") if c == "lang" else F.col(f"in_{c}")).alias(c) for c in docs.columns))
