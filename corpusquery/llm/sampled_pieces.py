"""Sampled segmentations over a SentencePiece vocabulary, by forward filtering and backward sampling.

A text is escaped as SentencePiece does (a leading mark, spaces as marks) and its lattice has an edge for every piece of
the vocabulary that matches, or a byte piece for each byte of a character that no piece covers. With edge weights
exp(-ALPHA * cost), forward sums over the lattice are filtered from the left, and one path is drawn from the right, each
edge in proportion to its share: an exact draw from the distribution over all segmentations. The cost of a piece is
1 + its rank / vocabulary size: merges are learned in order of frequency, so frequent pieces cost less, and so do fewer.

A piece has marks only at its front or consists of marks (a vocabulary with any other is refused). A lattice can thus be cut
before each mark that follows another character: no piece spans such a cut, the parts are independent, and a worker filters
each distinct part once. Draws come from a counter-based hash of (row key, part's place, end of the edge) and the seed: the
same key and text give the same segmentation wherever and whenever they are processed. Keys are whole numbers; of any other
kind, a 64-bit hash of the key as text is taken.

Decoding is lossless: a mark in the text itself is spelled in bytes, so that every other mark means a space, and byte
pieces join to the bytes that they spell. Null and empty texts have no pieces and decode to the empty text; very long
texts are one lattice cut in parts, a part without a space is one lattice of its own length. Repeated rows give the same
pieces, and so do equal texts without a key, which draw as key 0. Other columns are kept or ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import read
from .kernels import U64, lean, mix, powers

MARK = "▁"
ALPHA = 2.0
SEED = 17
#: Characters of texts that are drawn at once.
GROUP_CHARS = 1 << 18
#: Distinct parts whose lattices a worker keeps; further ones are filtered for the texts at hand.
CACHE_PARTS = 100_000
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _hashed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the code points before each place, times powers, and the inverse powers: any substring's hash is a difference."""
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return sums, down


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Vocabulary:
    """Pieces with costs, from a SentencePiece model file."""

    _open: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.spelled: list[bytes] = []
        plain = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} has a mark behind another character")
                plain.append(i)
                self.spelled.append(piece.replace(MARK, " ").encode())
        self.cost = 1.0 + np.arange(size) / size
        #: By length in characters: sorted hashes of the pieces, their ids, and a sieve over the hashes' upper bits.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(self.pieces[i]) for i in plain}):
            own = [i for i in plain if len(self.pieces[i]) == length]
            sums, down = _hashed(_points("".join(self.pieces[i] for i in own)))
            at = np.arange(len(own)) * length
            hashes = (sums[at + length] - sums[at]) * down[at]
            order = np.argsort(hashes)
            sieve = np.zeros(1 << 18, bool)
            sieve[hashes >> U64(46)] = True
            self.by_length[length] = hashes[order], np.array(own)[order], sieve

    @classmethod
    def get(cls, path: str) -> Vocabulary:
        """One for each worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids) -> str:
        """The text of a sequence of ids: without the leading space that stands for the leading mark as a mark."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:].decode()

    def bytes_of(self, point: int) -> list[int]:
        """Ids of the byte pieces that spell a character."""
        return self.byte_ids[list((MARK if point == ord(_LITERAL) else chr(point)).encode())].tolist()


def _numbers_of(keys: list) -> list[int]:
    """Keys as signed 64-bit numbers."""
    return [0 if k is None else k if isinstance(k, int) else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little", signed=True) for k in keys]


#: Stands for a mark that a text itself has: a lone surrogate, which no text from Arrow can have.
_LITERAL = "\udcff"


class _Grown:
    """An array with room to append to."""

    def __init__(self, dtype):
        self.room, self.size = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            more = np.empty(max(2 * len(self.room), self.size + len(values)), self.room.dtype)
            more[: self.size] = self.now
            self.room = more
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.size]


class _Numbers(dict):
    """Numbers of parts; one that is met for the first time gets the next and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class Lattices:
    """Filtered lattices of the distinct parts that a worker has met, in flat arrays. A part of n characters has n + 1 nodes
    from ``base`` on; a node has the edges first[node] to first[node + 1], each with the place in the part where it begins,
    its piece (or -1 - code point, for a character in bytes) and the running sum of the node's shares. A node's numbers
    come from its own part alone, in the same order of operations whatever else is filtered beside it."""

    _kept: Lattices | None = None

    def __init__(self, v: Vocabulary, alpha: float = ALPHA):
        self.v, self.alpha = v, alpha
        self.clear()

    @classmethod
    def kept(cls, v: Vocabulary, alpha: float) -> Lattices:
        """One for each worker process, vocabulary and alpha; another alpha starts anew."""
        if cls._kept is None or cls._kept.v is not v or cls._kept.alpha != alpha:
            cls._kept = cls(v, alpha)
        return cls._kept

    def arrays(self) -> list[_Grown]:
        return [self.base, self.length, self.first, self.begin, self.piece, self.share]

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.base, self.length = _Grown(np.int64), _Grown(np.int64)
        self.first, self.begin, self.piece, self.share = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32), _Grown(np.float32)
        self.first.add(np.zeros(1, np.int64))

    def _add(self, parts: list[str]) -> None:
        v = self.v
        points = _points("".join(parts))
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(length) - length
        part = np.repeat(np.arange(len(parts)), length)
        base = start + np.arange(len(parts))
        place = np.arange(len(points))
        rest = (start + length)[part] - place
        sums, down = _hashed(points)
        covered = np.zeros(len(points), bool)
        begins, ends, ids, costs = [], [], [], []
        for n, (hashes, own, sieve) in v.by_length.items():
            if n > 1:
                place = place[rest[place] >= n]
            h = (sums[place + n] - sums[place]) * down[place]
            maybe = np.flatnonzero(sieve[h >> U64(46)])
            k = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            real = hashes[k] == h[maybe]
            at, k = place[maybe[real]], k[real]
            if n == 1:
                covered[at] = True
            begins.append(at)
            ends.append(at + n)
            ids.append(own[k])
            costs.append(v.cost[own[k]])
        bare = np.flatnonzero(~covered)
        begins.append(bare)
        ends.append(bare + 1)
        ids.append(-1 - points[bare].astype(np.int64))
        wide = points[bare]
        costs.append(2.0 * np.where(wide == ord(_LITERAL), 3, 1 + (wide >= 0x80) + (wide >= 0x800).astype(int) + (wide >= 0x10000)))
        begin, end, ids, cost = (np.concatenate(x) for x in (begins, ends, ids, costs))
        shift = part[begin]
        begin, end = begin + shift, end + shift
        order = np.argsort(end, kind="stable")
        begin, weight, end = begin[order], -self.alpha * cost[order], end[order]
        nodes = len(points) + len(parts)
        first = np.searchsorted(end, np.arange(nodes + 1))
        depth = np.arange(nodes) - np.repeat(base, length + 1)
        share = _filtered(begin, end, weight, first, depth)
        self.base.add(base + self.first.size - 1)
        self.length.add(length)
        self.first.add(first[1:] + self.begin.size)
        self.begin.add(depth[begin])
        self.piece.add(ids[order])
        self.share.add(share)

    def numbered(self, parts: list[str]) -> np.ndarray:
        """Numbers of parts, each given without the mark it begins with."""
        known = self.numbers
        known.new = []
        out = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        if known.new:
            self._add([MARK + part for part in known.new])
        return out

    def drawn(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of one path for each of the numbered parts: (pieces of each part, all pieces from left to right)."""
        all_first, all_begin, all_piece, all_share = self.first.now, self.begin.now, self.piece.now, self.share.now
        at, end, base = np.arange(len(numbers)), self.length.now[numbers], self.base.now[numbers]
        rounds = []
        while len(at):
            u = (mix(keys + end.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53
            node = base + end
            edge, last = all_first[node], all_first[node + 1] - 1
            open_ = np.flatnonzero(edge < last)
            while len(open_):
                open_ = open_[all_share[edge[open_]] <= u[open_]]
                edge[open_] += 1
                open_ = open_[edge[open_] < last[open_]]
            rounds.append((at, all_piece[edge]))
            end = all_begin[edge]
            left = np.flatnonzero(end)
            at, end, base, keys = at[left], end[left], base[left], keys[left]
        counts = np.zeros(len(numbers), np.int64)
        for at, _ in rounds:
            counts[at] += 1
        last = np.cumsum(counts) - 1
        out = np.empty(counts.sum(), np.int32)
        for back, (at, piece) in enumerate(rounds):
            out[last[at] - back] = piece
        return counts, out

    def segment(self, texts: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """Ids of one sampled segmentation of each text."""
        full, sizes_before = len(self.numbers) >= CACHE_PARTS, [x.size for x in self.arrays()]
        v, parts, counts = self.v, [], []
        for text in texts:
            own = parted(text)
            parts += own
            counts.append(len(own))
        if not parts:
            return [np.zeros(0, np.int32) for _ in texts]
        counts = np.array(counts, np.int64)
        within = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = mix(np.array(keys, np.int64).view(U64) ^ mix(np.array([seed], U64)))
        sizes, piece = self.drawn(self.numbered(parts), mix(np.repeat(own, counts) + within.astype(U64)))
        if full:  # what is new is forgotten again: the words that a worker met first are mostly the frequent ones
            for part in self.numbers.new:
                del self.numbers[part]
            for x, size in zip(self.arrays(), sizes_before, strict=True):
                x.size = size
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            points, which = np.unique(piece[bare], return_inverse=True)
            spelled = [np.array(v.bytes_of(-1 - p), np.int32) for p in points.tolist()]
            width = np.ones(len(piece), np.int64)
            width[bare] = np.array([len(x) for x in spelled])[which]
            in_bytes = np.repeat(piece < 0, width)
            ends = np.concatenate(([0], np.cumsum(width)))[ends]
            piece = np.repeat(piece, width)
            piece[in_bytes] = np.concatenate([spelled[k] for k in which])
        return np.split(piece, ends[:-1])


def _filtered(begin: np.ndarray, end: np.ndarray, weight: np.ndarray, first: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Forward filtering, of all parts side by side: log sums over all paths to the nodes at one distance after the other. Gives each edge's running share."""
    log = np.zeros(len(depth))
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
    for a, b in zip(cuts, cuts[1:]):
        node = by_depth[a:b]
        count = first[node + 1] - first[node]
        head = np.cumsum(count) - count
        edge = np.repeat(first[node] - head, count) + np.arange(count.sum())
        x = log[begin[edge]] + weight[edge]
        most = np.maximum.reduceat(x, head)
        log[node] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, count)), head))
    share = np.exp(log[begin] + weight - log[end])
    edge, last = first[:-1][np.diff(first) > 1] + 1, first[1:][np.diff(first) > 1]
    while len(edge):
        share[edge] += share[edge - 1]
        edge, last = edge[edge + 1 < last] + 1, last[edge + 1 < last]
    return share


def parted(text: str) -> list[str]:
    """The parts of an escaped text, each without the mark that it begins with."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, _LITERAL)
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [part[1:] for part in _PARTS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def _groups(column: pa.Array):
    """Runs of rows, of GROUP_CHARS characters or so, with their texts; a null is an empty one."""
    a = size = 0
    for b, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        if b > a and size + n > GROUP_CHARS:
            yield a, b, [x or "" for x in column.slice(a, b - a).to_pylist()]
            a, size = b, 0
        size += n
    if a < len(column):
        yield a, len(column), [x or "" for x in column.slice(a).to_pylist()]


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with a column ids (array of int): a segmentation of the whole text, drawn by its key. A null key draws as 0. A column ids is replaced."""
    docs = docs.drop("ids")

    @lean
    def each(batches):
        lattices = Lattices.kept(Vocabulary.get(model), alpha)
        for batch in batches:
            keys = _numbers_of(batch[key].to_pylist())
            for a, b, texts in _groups(batch[text]):
                rows = lattices.segment(texts, keys[a:b], seed)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(each, StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())))


def decode(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """coded with a column decoded, the text that the ids spell, in place of one that it has."""
    coded = coded.drop("decoded")

    @lean
    def each(batches):
        v = Vocabulary.get(model)
        for batch in batches:
            texts = pa.array([v.decode(x or []) for x in batch[ids].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(each, StructType([*coded.schema.fields]).add("decoded", StringType()))


def digested(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and lossless (the ids decode to the text), in one pass."""

    @lean
    def each(batches):
        v = Vocabulary.get(model)
        lattices = Lattices.kept(v, alpha)
        for batch in batches:
            keys = _numbers_of(batch.column(0).to_pylist())
            for a, b, texts in _groups(batch.column(1)):
                rows = lattices.segment(texts, keys[a:b], seed)
                back = [v.decode(r.tolist()) == t for r, t in zip(rows, texts, strict=True)]
                crcs = [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in rows], pa.int64()), pa.array(crcs, pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, lossless boolean")


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return digested(read(spark, sf_dir, "documents"), model or _model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids; the text itself can be had from them."""
    return encode(docs.select("doc_id", "text"), _model()).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")
