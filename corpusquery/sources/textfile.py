"""Whole text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import universal_newlines


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source (the file's name) and text, with line ends made line feeds. A path that isn't there is an error, and so is a file that isn't UTF-8.

    Chunk ids are made from the source, so two files of one name are an error as well."""
    text = universal_newlines(F.validate_utf8(F.col("value")))
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), text.alias("text"))
    rows = rows.withColumn("source", F.url_decode(F.replace("source", F.lit("+"), F.lit("%2B"))))
    twice = rows.groupBy("source").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"several files are named {twice[0]}")
    return rows


def check_chunks(chunks: DataFrame, path: str) -> DataFrame:
    if chunks.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return chunks
