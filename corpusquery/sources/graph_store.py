"""A graph on disk that documents are added to, and taken out of, at the cost of what changes.

Under a path stand parts; each has a ledger (source and digest of its documents' texts), their chunks, and what was extracted
from them: nodes and edges by chunk, whose numbers are sums to be added up. A document counts as its latest part has it; a part
whose ledger has no digest for it takes it out. Parts count once they are whole. Reading merges them (``graph.merged``), leaving out
what later parts replace; ``compact`` writes what counts as one part.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.chunking import chunk
from . import tables

TABLES = {
    "ledger": "source string, digest string",
    "chunks": "source string, chunk_id string, text string",
    "nodes": "source string, name string, chunk_id string, type string, description string, n bigint",
    "edges": "source string, src string, dst string, chunk_id string, description string, keywords array<string>, n bigint",
}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, table: str) -> DataFrame:
        """All parts' rows, with the part."""
        names = tables.parts(self.spark, self.path)
        if not names:
            return self.spark.createDataFrame([], f"{TABLES[table]}, part string")
        folders = [f"{self.path}/{table}/part={n}" for n in names]
        return self.spark.read.schema(f"{TABLES[table]}, part string").option("basePath", f"{self.path}/{table}").parquet(*folders)

    def ledger(self) -> DataFrame:
        """source, digest, part of the documents that count."""
        last = self._read("ledger").groupBy("source").agg(F.max(F.struct("part", "digest")).alias("x"))
        return last.select("source", "x.digest", "x.part").filter("digest IS NOT NULL")

    def _live(self, table: str) -> DataFrame:
        """Rows of the documents that count. What is replaced is few beside what stays, and is left out by a join that Spark makes a broadcast where it is small."""
        last = self._read("ledger").groupBy("source").agg(F.max("part").alias("last"))
        old = self._read("ledger").join(last, "source").filter("part < last").select("source", "part")
        return self._read(table).join(old, ["source", "part"], "left_anti").drop("part")

    def _write(self, rows: dict[str, DataFrame]) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        for table, schema in TABLES.items():
            some = rows.get(table)
            some = self.spark.createDataFrame([], schema) if some is None else some
            some.select(*(f.split()[0] for f in schema.split(", "))).write.parquet(f"{self.path}/{table}/part={name}")
        tables.mark(self.spark, self.path, name)
        return name

    def insert(self, docs: DataFrame, extractor: Callable | None = None, size: int = 400, overlap: int = 60, assignments: bool = False) -> int:
        """docs(source, text): adds new documents, replaces those whose text has changed, and skips the rest, which no model is asked about. How many were added or replaced.

        A source that stands several times is an error; a null text is an empty one."""
        rows = docs.select("source", F.coalesce("text", F.lit("")).alias("text"))
        rows = tables.materialise(rows.withColumn("digest", F.sha2("text", 256)), "inserted")
        twice = rows.groupBy("source").count().filter("count > 1 OR source IS NULL").first()
        if twice:
            raise ValueError(f"several documents, or one without a name, are {twice[0]}")
        new = tables.materialise(rows.join(self.ledger().select("source", "digest"), ["source", "digest"], "left_anti"), "new")
        count = new.count()
        if not count:
            tables.drop(rows, new)
            return 0
        chunks = tables.materialise(chunk(new.select("source", "text"), size=size, overlap=overlap, assignments=assignments).select("source", "chunk_id", "text"), "chunks")
        nodes, edges = graph.parted(chunks.select("chunk_id", "text"), extractor)
        source = F.regexp_replace("chunk_id", r"#chunk-[0-9]+\z", "").alias("source")
        self._write({"ledger": new.select("source", "digest"), "chunks": chunks, "nodes": nodes.select("*", source), "edges": edges.select("*", source)})
        tables.drop(rows, new, chunks, nodes, edges)
        return count

    def withdraw(self, sources: DataFrame) -> int:
        """sources(source): takes documents out. How many there were."""
        gone = tables.materialise(self.ledger().join(sources.select("source").distinct(), "source", "left_semi").select("source", F.lit(None).cast("string").alias("digest")), "gone")
        count = gone.count()
        if count:
            self._write({"ledger": gone})
        return count

    def chunks(self) -> DataFrame:
        return self._live("chunks").select("chunk_id", "text", "source")

    def graph(self, summariser: Callable | None = None) -> graph.Graph:
        """The graph of all documents that count."""
        return graph.merged(self._live("nodes").drop("source"), self._live("edges").drop("source"), summariser)

    def compact(self) -> None:
        """One part of what counts in place of all. A reader sees the parts before or the part after."""
        before = tables.parts(self.spark, self.path)
        if len(before) > 1:
            self._write({"ledger": self.ledger().select("source", "digest"), **{t: tables.materialise(self._live(t), t) for t in ("chunks", "nodes", "edges")}})
            self._drop(before)

    def clear(self) -> None:
        self._drop(tables.parts(self.spark, self.path))

    def _drop(self, names: list[str]) -> None:
        tables.unmark(self.spark, self.path, names)
        for table in TABLES:
            for name in names:
                files, where = tables.hadoop_path(self.spark, f"{self.path}/{table}/part={name}")
                files.delete(where, True)
