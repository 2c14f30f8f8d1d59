"""Prompts for language models, built as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NO_CONTEXT = "The indexed documents hold nothing that answers this question."
_ANSWER = "Answer the question from the context alone. Where the context doesn't hold the answer, say so, and add nothing of your own.\n\nContext:\n%s\n\nQuestion:\n%s\n\nAnswer:"
_RERANK = (
    "Rate how well each numbered passage answers the query, from 0.00 (not at all) to 10.00 (fully and exactly).\n\nQuery: \"%s\"\n\nPassages:\n%s\n\n"
    'Reply with nothing but a JSON array that has an object for each passage: [{"index": 0, "score": 8.5}]'
)
_SCALE = 'Reply with nothing but JSON: {"score": <from 0.0 to 1.0>}'
_CONTEXT_RELEVANCE = f"How relevant is the passage to the question? 1.0: it answers it; 0.0: it has nothing to do with it.\n\nQuestion: %s\n\nPassage: %s\n\n{_SCALE}"
_GROUNDEDNESS = f"How far does the context bear out the answer? 1.0: every statement; 0.0: none.\n\nContext: %s\n\nAnswer: %s\n\n{_SCALE}"
_ANSWER_RELEVANCE = f"How directly does the answer meet the question? 1.0: fully; 0.0: not at all.\n\nQuestion: %s\n\nAnswer: %s\n\n{_SCALE}"
CHUNK_CHARS, CONTEXT_CHARS = 1500, 3000


def ordered_texts(ranked: DataFrame) -> DataFrame:
    """ranked(query_id, rank, chunk_id, text): a query's few results as one array in rank order."""
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("results"))


def context(results: Column, title: str = "Chunk") -> Column:
    """Blocks with number and id above each text, and an empty line between them."""
    return F.array_join(F.transform(results, lambda r, i: F.concat(F.lit(f"[{title} "), i + 1, F.lit(" - ID: "), r["chunk_id"], F.lit("]\n"), r["text"])), "\n\n")


def answer(results: Column, query: Column, title: str = "Chunk") -> Column:
    """The prompt, or null where there are no results: then NO_CONTEXT is the answer, and no model is asked."""
    return F.when(F.size(results) > 0, F.format_string(_ANSWER, context(results, title), query))


def rerank(results: Column, query: Column) -> Column:
    rows = F.array_join(F.transform(results, lambda r, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.replace(r["text"], F.lit("\n"), F.lit(" ")))), "\n")
    return F.format_string(_RERANK, query, rows)


def context_relevance(query: Column, chunk: Column) -> Column:
    return F.format_string(_CONTEXT_RELEVANCE, strip(query), F.substring(strip(chunk), 1, CHUNK_CHARS))


def groundedness(texts: Column, answer_: Column) -> Column:
    return F.format_string(_GROUNDEDNESS, strip(F.substring(F.array_join(texts, "\n\n"), 1, CONTEXT_CHARS)), strip(answer_))


def answer_relevance(query: Column, answer_: Column) -> Column:
    return F.format_string(_ANSWER_RELEVANCE, strip(query), strip(answer_))


def flattened_chat(prompt: Column, history: Column, system: Column) -> Column:
    """System text (if any), then ``role: content`` of each message (role user and empty content by default), then the prompt."""
    turns = F.transform(F.coalesce(history, F.array().cast("array<struct<role: string, content: string>>")), lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    first = F.when(F.coalesce(system, F.lit("")) != "", F.array(system)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, turns, F.array(prompt)), "\n\n")
