"""The three judge scores of an answer: relevance of the context, groundedness, relevance of the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp, extract_score

NEUTRAL = 0.5


def _score(reply: str):
    """No reply: neutral."""
    return F.when(F.col(reply).isNotNull(), extract_score(F.col(reply), F.lit(NEUTRAL))).otherwise(NEUTRAL)


def evaluate(answers: DataFrame, chunk_replies: DataFrame, answer_replies: DataFrame) -> DataFrame:
    """answers(query_id), chunk_replies(query_id, reply: one for each chunk), answer_replies(query_id, grounded_reply, relevant_reply)
    -> query_id, context_relevance, groundedness, answer_relevance, composite. Whatever is missing counts as 0.5."""
    mean = chunk_replies.select("query_id", _score("reply").alias("s")).groupBy("query_id").agg(clamp(F.avg("s")).alias("context_relevance"))
    each = answer_replies.select("query_id", _score("grounded_reply").alias("groundedness"), _score("relevant_reply").alias("answer_relevance"))
    out = answers.select("query_id").join(mean, "query_id", "left").join(each, "query_id", "left")
    out = out.select("query_id", *(F.coalesce(c, F.lit(NEUTRAL)).alias(c) for c in ("context_relevance", "groundedness", "answer_relevance")))
    return out.withColumn("composite", clamp((F.col("context_relevance") + F.col("groundedness") + F.col("answer_relevance")) / 3.0))


def rounded(triad: DataFrame) -> DataFrame:
    return triad.withColumns({c: F.bround(c, 4) for c in ("context_relevance", "groundedness", "answer_relevance", "composite")})
