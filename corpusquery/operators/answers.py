"""Answers from the graph: a context of entities, relations and passages, each under a budget of words, and the model's answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import providers
from ..sources.tables import materialise
from . import graph as G
from .prompts import NO_CONTEXT, context
from .ranking import top_k

_ANSWER = "Answer the question from the context alone. Where the context doesn't hold the answer, say so, and add nothing of your own.\n\nEntities:\n%s\n\nRelations:\n%s\n\nPassages:\n%s\n\nQuestion:\n%s\n\nAnswer:"


@dataclass(frozen=True)
class Budget:
    """Words of each part of the context, and the rows of each that are looked at."""

    entities: int = 400
    relations: int = 400
    passages: int = 1200
    rows: int = 64


def words(text: Column) -> Column:
    """Number of words between blanks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+"), F.lit(0)))


def within(ranked: DataFrame, text: str, budget: int) -> DataFrame:
    """ranked(query_id, rank, text, ...): the rows of each query from the first on whose words together stay within the budget. No text is cut."""
    so_far = F.sum("n_words").over(W.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("n_words", words(F.col(text))).withColumn("so_far", so_far).filter(F.col("so_far") <= budget).drop("so_far")


def _weighted_pairs(graph: G.Graph, queries: DataFrame, seeds: DataFrame, mode: str, embedder, near: int, digits: int | None, text) -> DataFrame:
    """query_id, src, dst, w: relations at the query's entities (local), or the nearest ones (global, with an embedder)."""
    both = graph.relations.select("src", "dst", F.col("src").alias("name")).union(graph.relations.select("src", "dst", "dst"))
    at = lambda rows: rows.join(both, "name").groupBy("query_id", "src", "dst").agg(F.max("w").alias("w"))
    beside = at(seeds)
    if mode == "local" or embedder is None:
        return beside
    nearest = G.pairs(graph, text("high"), embedder, near, digits)
    return nearest if mode == "global" else beside.unionByName(nearest).groupBy("query_id", "src", "dst").agg(F.max("w").alias("w"))


def contexts(
    graph: G.Graph, queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = 5, embedder: Callable | None = None, near: int = 10, digits: int | None = None, keywords: DataFrame | None = None, budget: Budget = Budget()
) -> DataFrame:
    """query_id, entities, relations, passages (texts) and how many each holds, for every query: graph search's finds, each part in its order and under its budget.

    Entities are ranked by weight, mentions and name (of the query's entities and those one relation away), relations by weight,
    mentions and ends, passages by ``graph.search``. Only ``budget.rows`` rows of a part are looked at."""
    if mode not in G.MODES[1:]:
        raise ValueError(f"mode must be one of {', '.join(G.MODES[1:])}: {mode}")
    if embedder is not None and graph.entity_vectors is None:
        graph = graph.embedded(embedder)
    text = lambda level: G.at_level(queries, keywords, level)
    seeds = materialise(G.seeds(graph, text("low"), embedder, near, digits), "seeds")
    told = F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise("")

    hood = G.neighbourhood(graph, seeds, digits).join(graph.entities, "name")
    nodes = top_k(hood, budget.rows, F.desc("w2"), F.desc("mentions"), F.col("name"))
    nodes = within(nodes.select("query_id", "rank", F.concat("name", F.lit(" ("), "type", F.lit(")"), told).alias("line")), "line", budget.entities)

    met = _weighted_pairs(graph, queries, seeds, mode, embedder, near, digits, text).join(graph.relations, ["src", "dst"])
    edges = top_k(met, budget.rows, F.desc("w"), F.desc("mentions"), F.col("src"), F.col("dst"))
    line = F.concat("src", F.lit(" -- "), "dst", F.lit(" ("), F.array_join("keywords", ", "), F.lit(")"), told)
    edges = within(edges.select("query_id", "rank", line.alias("line")), "line", budget.relations)

    found = G.search(graph, queries, mode, min(k, budget.rows), embedder=embedder, near=near, digits=digits, keywords=keywords)
    found = within(found.select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id"), "text", budget.passages)

    def part(rows: DataFrame, name: str, value: Column) -> DataFrame:
        """One row a query: what is left is bounded by the budget."""
        kept = F.array_sort(F.collect_list(F.struct("rank", *(c for c in ("chunk_id", "text", "line") if c in rows.columns))))
        return rows.groupBy("query_id").agg(kept.alias("kept")).select("query_id", value.alias(name), F.size("kept").cast("long").alias(f"n_{name}"))

    lines = F.array_join(F.transform("kept", lambda r: r["line"]), "\n")
    out = queries.select("query_id", "text")
    for rows, name, value in ((nodes, "entities", lines), (edges, "relations", lines), (found, "passages", context(F.col("kept")))):
        out = out.join(part(rows, name, value), "query_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("entities", "relations", "passages")} | {f"n_{n}": F.coalesce(f"n_{n}", F.lit(0)).cast("long") for n in ("entities", "relations", "passages")})


def answered(contexts: DataFrame, model: Callable) -> DataFrame:
    """The contexts with prompt and answer, a table. Where nothing was found no model is asked."""
    prompt = F.when(F.col("n_entities") + F.col("n_relations") + F.col("n_passages") > 0, F.format_string(_ANSWER, "entities", "relations", "passages", "text"))
    rows = contexts.withColumn("prompt", prompt)
    return materialise(rows.withColumn("answer", F.when(F.col("prompt").isNull(), NO_CONTEXT).otherwise(F.trim(providers.completed(F.col("prompt"), model)))), "answers")
