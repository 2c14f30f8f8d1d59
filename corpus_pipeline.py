"""From raw documents to sampled token ids: language, toxicity, near duplicates, benchmark leaks, segmentation.

Each stage takes what its predecessor kept, written as Parquet in the folder of spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusquery.llm import decontaminate, language, ngram_join, sampled_pieces, toxicity
from corpusquery.llm.common import materialise, read

STAGES = [
    ("language identification", language.stage),
    ("toxicity", toxicity.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("SentencePiece encoding and decoding", sampled_pieces.stage),
]

#: No SQL expresses a trained network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
