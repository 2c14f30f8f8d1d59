"""A ledger of models' replies, so that a prompt is asked about once.

Replies are kept under a path by model and digest of the prompt, in parts that count once they are whole. ``ask`` takes each
distinct prompt once, leaves out those that have a reply, and asks about the rest part by part: each part is a job of its own,
committed when it ends. What fails, or an executor that is lost, costs the part that it was in; a run after that asks only for what
is still missing. A call without a reply (None) isn't kept, and is made again the next time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from . import tables

SCHEMA = "model string, digest string, prompt string, reply string"
#: Prompts of a part, about.
PART = 10_000


class Replies:
    def __init__(self, spark: SparkSession, path: str, part: int = PART):
        self.spark, self.path, self.part = spark, path, part

    def read(self) -> DataFrame:
        """model, digest, prompt, reply: one row for each model and prompt."""
        names = tables.parts(self.spark, self.path)
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        # two runs at a time may have asked the same: the smaller reply counts for both
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in names))
        return rows.groupBy("model", "digest", "prompt").agg(F.min("reply").alias("reply"))

    def ask(self, prompts: DataFrame, model: Callable, name: str, prompt: str = "prompt") -> int:
        """Asks the model that the factory gives about each prompt that has no reply under this name. How many there were."""
        text = F.col(prompt)
        rows = prompts.select(F.lit(name).alias("model"), F.sha2(text, 256).alias("digest"), text.alias("prompt")).filter("prompt IS NOT NULL").distinct()
        new = tables.materialise(rows.join(self.read().select("model", "digest"), ["model", "digest"], "left_anti"), "prompts")
        count = new.count()
        parts = -(-count // self.part)
        for k in range(parts):
            mine = new.filter(F.pmod(F.xxhash64("digest"), F.lit(parts)) == k)
            folder = f"part-{uuid.uuid4().hex}"
            # prompts are dealt evenly, so that calls run on all executors
            got = mine.repartition("digest").withColumn("reply", providers.completed(F.col("prompt"), model)).filter("reply IS NOT NULL")
            got.write.parquet(f"{self.path}/{folder}")
            tables.mark(self.spark, self.path, folder)
        return count

    def told(self, rows: DataFrame, prompt: Column, model: Callable, name: str, reply: str = "reply") -> DataFrame:
        """rows with a column of the model's reply to each row's prompt; a null prompt has none, and rows of one prompt share theirs."""
        rows = tables.materialise(rows.withColumn("_prompt", prompt).withColumn("_digest", F.sha2("_prompt", 256)), "asked")
        self.ask(rows, model, name, "_prompt")
        known = self.read().filter(F.col("model") == name).select(F.col("digest").alias("_digest"), F.col("reply").alias("_reply"))
        # rows without a prompt meet nothing, and are kept out of the join
        asked = rows.filter("_digest IS NOT NULL").join(known, "_digest", "left").select(*rows.columns, "_reply")
        none = rows.filter("_digest IS NULL").withColumn("_reply", F.lit(None).cast("string"))
        return asked.unionByName(none).drop("_prompt", "_digest").withColumnRenamed("_reply", reply)

    def clear(self) -> None:
        tables.unmark(self.spark, self.path, tables.parts(self.spark, self.path))
