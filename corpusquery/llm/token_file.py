"""Token ids on file: each document compressed by itself under one shared zstandard dictionary.

A table of shards holds the ids. Each shard is one binary image:

    bytes 0-7     magic "TOKSHRD1"
    32 bytes      sha256 of the dictionary
    u32 n         documents;  u32 width of an id in bytes (2 or 4)
    n x i64       ids of the documents, ascending (a null id: the smallest 64-bit integer)
    n x i64       tokens of each document
    (n+1) x u64   offset index: where each document's frame begins, from the end of this index
    frames        one zstandard frame for each document, without a dictionary id of its own

A reader with the dictionary gets at one document through the index, without touching the others. The shards' table also
has first_id and last_id, which Parquet's statistics make a filter on the scan, and the dictionary is a table beside it.
Both tables are written by Spark's own committer, so that a lost executor's task is simply run again.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_partitions, own_dir, read
from .kernels import lean
from .tokens import Encoder

MAGIC = b"TOKSHRD1"
#: Documents that the dictionary is trained on, the tokens taken of each, and its size in bytes: a bounded sample, for compression only.
SAMPLE_DOCS, SAMPLE_TOKENS, DICT_BYTES = 400, 4096, 32 << 10
#: A shard ends at the first document with which it has this many documents or bytes of ids.
SHARD_DOCS, SHARD_BYTES = 4096, 4 << 20
#: Documents handed to the tokeniser at once.
GROUP = 256
LEVEL = 3
_NULL = -(1 << 63)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> bytes:
    """A dictionary from the serialised ids of a fixed sample: the documents of the smallest hashes.

    Where the sample is too small for zstandard's trainer, the sample's own bytes are the dictionary (raw content); only without any document that has a key is it empty."""
    ids = [r[0] for r in docs.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCS).collect()]
    if not ids:
        return b""

    @lean
    def each(batches):
        encoder = Encoder.get(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                got = encoder.encode([x or "" for x in batch.column(0).slice(a, GROUP).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([x[: SAMPLE_TOKENS * encoder.dtype.itemsize] for x in got], pa.binary())], names=["ids"])

    end = np.array([end_id], Encoder.get(tokenizer).dtype).tobytes()
    sample = sorted(bytes(r[0]) + end for r in docs.filter(F.col(key).isin(ids)).select(text).mapInArrow(each, "ids binary").limit(SAMPLE_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def build_image(doc_ids: list[int | None], arrays: list[bytes], width: int, dictionary: bytes, compressor=None) -> bytes:
    compressor = compressor or _compressor(dictionary)
    frames = [compressor.compress(x) for x in arrays]
    n = len(arrays)
    index = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<II", n, width)
    ids = np.array([_NULL if x is None else x for x in doc_ids], "<i8")
    return b"".join((head, ids.tobytes(), np.array([len(x) // width for x in arrays], "<i8").tobytes(), index.tobytes(), *frames))


class Image:
    """A shard's image: the header is checked once, a document is read by its place."""

    def __init__(self, image: bytes, dictionary: bytes, decompressor=None):
        if image[:8] != MAGIC or image[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token shard of this dictionary")
        n, self.width = struct.unpack_from("<II", image, 40)
        self.ids = np.frombuffer(image, "<i8", n, 48)
        self.counts = np.frombuffer(image, "<i8", n, 48 + 8 * n)
        self.index = np.frombuffer(image, "<u8", n + 1, 48 + 16 * n)
        self.base, self.image = 48 + 16 * n + 8 * (n + 1), memoryview(image)
        self.decompressor = decompressor or _decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> np.ndarray:
        frame = self.image[self.base + int(self.index[k]) : self.base + int(self.index[k + 1])]
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Tokenises whole texts (null: empty), appends end_id, and writes the shards in ascending order of the key under ``path``.

    Null keys come first; rows of one key follow each other in no set order, and may fill several tasks, as ranges are cut
    by a seeded number too. Other columns are ignored. An empty table gives no shards and an empty dictionary."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, text, key)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    @lean
    def each(batches):
        encoder, compressor = Encoder.get(tokenizer), _compressor(dictionary)
        width, end = encoder.dtype.itemsize, np.array([end_id], encoder.dtype).tobytes()
        part, seq, ids, arrays, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            row = {"part": part, "seq": seq, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(ids), "n_tokens": size // width, "image": build_image(ids, arrays, width, dictionary, compressor)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                some = batch.slice(a, GROUP)
                for i, x in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids.append(i)
                    arrays.append(x + end)
                    size += len(arrays[-1])
                    if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                        yield shard()
                        seq, ids, arrays, size = seq + 1, [], [], 0
        if ids:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.rand(0).alias("salt"))
    ordered = rows.repartitionByRange(n_partitions(spark), "id", "salt").sortWithinPartitions("id", "salt").select("id", "text")
    ordered.mapInArrow(each, "part int, seq int, first_id long, last_id long, n_docs long, n_tokens long, image binary").write.parquet(f"{path}/shards")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    sha, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(dictionary := bytes(dictionary)).hexdigest() != sha:
        raise ValueError("the dictionary isn't the one that was written")
    return spark.read.parquet(f"{path}/shards"), dictionary


def _starts(shards: DataFrame) -> DataFrame:
    """part, seq and the tokens before each shard: sums of the parts first, then within each part."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = W.partitionBy("part").orderBy("seq")
    return sizes.join(before, "part").select("part", "seq", (F.col("part_start") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Reads every document back: doc_id, start (tokens before it), n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    shards, dictionary = _opened(spark, path)

    @lean
    def each(batches):
        decompressor = _decompressor(dictionary)
        for batch in batches:
            for blob, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                image = Image(blob.as_py(), dictionary, decompressor)
                crcs = [zlib.crc32(image.read(k).astype("<u4").tobytes()) for k in range(len(image))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.ids, pa.int64(), mask=image.ids == _NULL), pa.array(start + np.cumsum(image.counts) - image.counts), pa.array(image.counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return shards.join(_starts(shards), ["part", "seq"]).select("image", "start").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents: only shards whose range holds one are read, and of them only those documents' frames."""
    shards, dictionary = _opened(spark, path)
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    hit = F.lit(False)
    for i in wanted.tolist():
        hit |= (F.col("first_id") <= i) & (F.col("last_id") >= i)

    @lean
    def each(batches):
        decompressor = _decompressor(dictionary)
        for batch in batches:
            for blob in batch.column(0):
                image = Image(blob.as_py(), dictionary, decompressor)
                at = np.flatnonzero(np.isin(image.ids, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(image.ids[at]), pa.array([image.read(k).tolist() for k in at], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shards.filter(hit).select("image").mapInArrow(each, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return digest(spark, path)
