"""Vector tables on disk: added to, read, merged, cleared."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import check_dimensions, norm
from . import tables

SINGLE = "chunk_id string, embedding array<float>, norm double"
MULTI = "chunk_id string, embeddings array<array<float>>"


class VectorStore:
    """Vectors in parts under a path, one for each call of ``add``; ``schema`` is SINGLE or MULTI.

    What a part replaces in earlier ones, and what is deleted, is noted beside it when it is written: by chunk and part. So reading
    is a plain scan of the parts, less the notes where there are any; ``compact`` makes one part of what counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SINGLE):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Adds a vector for each chunk. chunks(chunk_id), vectors(chunk_id, embedding or embeddings).

        A chunk without a vector, a vector without a chunk, another number of them, or a dimension other than that of the
        vectors there are is an error, before anything is written. No chunk at all adds nothing. Of several vectors of one chunk in
        a call the smallest counts (by its first entry that differs); of several calls, the last one's."""
        n, m = chunks.count(), vectors.count()
        if n != m:
            raise ValueError(f"{n} chunks but {m} vectors")
        if not n:
            return
        alone = chunks.select("chunk_id").exceptAll(vectors.select("chunk_id")).first() or vectors.select("chunk_id").exceptAll(chunks.select("chunk_id")).first()
        if alone:
            raise ValueError(f"chunks and vectors don't match: {alone[0]}")
        value = self.schema.split(", ")[1].split()[0]
        rows = vectors.groupBy("chunk_id").agg(F.min(value).alias(value))
        own, there = self._dimension(vectors), self._dimension(self.read())
        if there is not None and own != there:
            raise ValueError(f"vectors of {own} dimensions; those in the store have {there}")
        if self.schema == SINGLE:
            rows = rows.withColumn("norm", norm(F.col("embedding")))
        self._write(rows, rows.select("chunk_id"))

    def delete(self, chunks: DataFrame) -> None:
        """chunks(chunk_id): takes their vectors out. Those that aren't there are ignored."""
        self._write(None, chunks.select("chunk_id").distinct())

    def _write(self, rows: DataFrame | None, replaced: DataFrame) -> str:
        """A part of the rows, and the note of what no longer counts in the parts before it."""
        part = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        before = self._rows()
        old = before.select("chunk_id", F.col("part").alias("old")).join(replaced, "chunk_id", "left_semi") if before is not None else None
        if old is not None:
            old.write.parquet(f"{self.path}/gone/part={part}")
        if rows is not None:
            rows.select(*(F.col(f.split()[0]).cast(f.split(maxsplit=1)[1]) for f in self.schema.split(", "))).write.parquet(f"{self.path}/rows/part={part}")
        tables.mark(self.spark, self.path, part)
        return part

    def _there(self, table: str) -> list[str]:
        folders = [f"{self.path}/{table}/part={n}" for n in tables.parts(self.spark, self.path)]
        return [f for f in folders if (p := tables.hadoop_path(self.spark, f))[0].exists(p[1])]

    def _rows(self) -> DataFrame | None:
        """Rows that count, with their part."""
        folders, noted = self._there("rows"), self._there("gone")
        if not folders:
            return None
        rows = self.spark.read.schema(f"{self.schema}, part string").option("basePath", f"{self.path}/rows").parquet(*folders)
        if noted:
            gone = self.spark.read.schema("chunk_id string, old string").parquet(*noted)
            if not gone.isEmpty():
                rows = rows.join(gone.withColumnRenamed("old", "part").distinct(), ["chunk_id", "part"], "left_anti")
        return rows

    def _dimension(self, vectors: DataFrame) -> int | None:
        if self.schema == SINGLE:
            return check_dimensions(vectors)
        return check_dimensions(vectors.select(F.explode("embeddings").alias("embedding")))

    def read(self) -> DataFrame:
        """All rows; of a chunk that was added several times, the one that was added last."""
        rows = self._rows()
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.select(*(f.split()[0] for f in self.schema.split(", ")))

    def compact(self) -> None:
        """One part of what counts, without notes, in place of all. A reader sees the parts before, or the part after."""
        before = tables.parts(self.spark, self.path)
        if len(before) > 1:
            rows = tables.materialise(self.read(), "compacted")
            part = self._write(rows, rows.select("chunk_id"))
            self._drop(before)
            # what it noted of the parts before is void with them
            files, where = tables.hadoop_path(self.spark, f"{self.path}/gone/part={part}")
            files.delete(where, True)

    def clear(self) -> None:
        self._drop(tables.parts(self.spark, self.path))

    def _drop(self, names: list[str]) -> None:
        tables.unmark(self.spark, self.path, names)
        for table in ("rows", "gone"):
            for name in names:
                files, where = tables.hadoop_path(self.spark, f"{self.path}/{table}/part={name}")
                files.delete(where, True)
