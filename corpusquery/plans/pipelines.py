"""Question answering over chunks, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..operators import dense, fusion, prompts, rerank, sparse, triad
from ..operators.chunking import chunk
from ..operators.ranking import checked_k
from ..sources.replies import Replies
from ..sources.tables import materialise
from .config import Config


@dataclass
class Results:
    """One table for each stage; those that a pipeline doesn't have are None."""

    dense: DataFrame
    answers: DataFrame
    sparse: DataFrame | None = None
    fused: DataFrame | None = None
    reranked: DataFrame | None = None
    triad: DataFrame | None = None


def _with_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select("chunk_id", "text"), "chunk_id")


def _told(rows: DataFrame, prompt: Column, model: Callable, config: Config, reply: str, judge: bool = False) -> DataFrame:
    """rows with the model's replies, a table; from the ledger of replies where one is kept."""
    if config.reply_dir:
        name = judge and config.judge_model or config.llm_model
        return materialise(Replies(rows.sparkSession, config.reply_dir).told(rows, prompt, model, name, reply), "replies")
    return materialise(rows.withColumn(reply, providers.completed(prompt, model)), "replies")


def _answered(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, model: Callable, title: str, config: Config) -> DataFrame:
    """query_id, text, results, prompt, answer: a table, so that the answer that is judged or shown is the one that was given."""
    rows = queries.select("query_id", "text").join(prompts.ordered_texts(_with_text(ranked, chunks)), "query_id", "left").withColumn("results", F.coalesce("results", F.array()))
    rows = rows.withColumn("prompt", prompts.answer(F.col("results"), F.col("text"), title))
    rows = _told(rows, F.col("prompt"), model, config, "answer")
    return rows.withColumn("answer", F.when(F.col("prompt").isNull(), prompts.NO_CONTEXT).otherwise(F.trim("answer")))


class Basic:
    """Chunks, single vectors, the nearest chunks, an answer. Chunks and vectors are made once, as tables."""

    def __init__(self, docs: DataFrame, embedder: Callable | None = None, model: Callable | None = None, config: Config | None = None):
        self.config = config or Config()
        self.embedder, self.model = embedder or self.config.embedder(), model or self.config.model()
        self.chunks = materialise(chunk(docs, size=self.config.chunk_size, overlap=self.config.chunk_overlap), "chunks")
        self.vectors = materialise(providers.embedded(self.chunks, self.embedder).select("chunk_id", "embedding"), "vectors")

    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        asked = materialise(providers.embedded(queries.select("query_id", "text"), self.embedder), "queries")
        return dense.cosine_search(self.vectors, asked, checked_k(k, self.config.top_k), self.config.score_digits)

    def query(self, queries: DataFrame, k: int | None = None) -> Results:
        found = materialise(self.retrieve(queries, k), "dense")
        return Results(found, _answered(queries, found, self.chunks, self.model, "Chunk", self.config))


class Hybrid:
    """Chunks, BM25L beside vectors (one a chunk, or one a token), fusion, reranking, an answer and its judgement.

    Chunks, index and vectors are made once, as tables; so is each list and every model's reply, so that a model is asked once
    for each reranking, answer and judgement, and what is judged is what is returned."""

    def __init__(self, docs: DataFrame, embedder: Callable | None = None, model: Callable | None = None, config: Config | None = None, judge: Callable | None = None):
        self.config = c = config or Config()
        self.multi = c.backend == "multi"
        self.embedder = embedder or (c.multi_embedder() if self.multi else c.embedder())
        self.model = model or c.model()
        self.judge = judge or model or c.model(judge=True)
        self.chunks = materialise(chunk(docs, size=c.chunk_size, overlap=c.chunk_overlap, assignments=True), "chunks")
        self.index = sparse.index(self.chunks).kept()
        self.vectors = materialise(self._embedded(self.chunks).select("chunk_id", "embeddings" if self.multi else "embedding"), "vectors")

    def _embedded(self, rows: DataFrame, queries: bool = False) -> DataFrame:
        return providers.token_embedded(rows, self.embedder, queries=queries) if self.multi else providers.embedded(rows, self.embedder)

    def retrieve(self, queries: DataFrame, top_k_sparse: int | None = None, top_k_dense: int | None = None, rrf_k: int | None = None, top_n: int | None = None) -> Results:
        c = self.config
        words = materialise(sparse.search(self.index, queries, checked_k(top_k_sparse, c.top_k_sparse), digits=c.score_digits, k1=c.k1, b=c.b, delta=c.delta), "sparse")
        asked = materialise(self._embedded(queries.select("query_id", "text"), queries=True), "queries")
        near = materialise((dense.maxsim_search if self.multi else dense.cosine_search)(self.vectors, asked, checked_k(top_k_dense, c.top_k_dense), c.score_digits), "dense")
        fused = materialise(fusion.fuse(near, words, checked_k(rrf_k, c.rrf_k)), "fused")
        lists = prompts.ordered_texts(_with_text(fused, self.chunks)).join(queries.select("query_id", "text"), "query_id")
        ask = F.when(F.size("results") > 1, prompts.rerank(F.col("results"), F.col("text")))
        replies = _told(lists.select("query_id", ask.alias("ask")), F.col("ask"), self.model, c, "reply").select("query_id", "reply")
        return Results(near, queries.select("query_id"), words, fused, materialise(rerank.rerank(fused, replies, checked_k(top_n, c.top_n_rerank)), "reranked"))

    def query(self, queries: DataFrame, **numbers) -> Results:
        got = self.retrieve(queries, **numbers)
        got.answers = _answered(queries, got.reranked, self.chunks, self.model, "Document Chunk", self.config)
        if self.config.evaluate:
            ask = lambda rows, prompt, reply: _told(rows, prompt, self.judge, self.config, reply, judge=True)
            each = got.answers.select("query_id", "text", F.explode("results").alias("r"))
            relevance = ask(each.select("query_id", prompts.context_relevance(F.col("text"), F.col("r.text")).alias("ask")), F.col("ask"), "reply").select("query_id", "reply")
            texts = F.transform("results", lambda r: r["text"])
            answered = F.coalesce("answer", F.lit("")) != ""
            grounded = F.when(answered & (F.size("results") > 0), prompts.groundedness(texts, F.col("answer")))
            relevant = F.when(answered, prompts.answer_relevance(F.col("text"), F.col("answer")))
            both = ask(got.answers.select("query_id", grounded.alias("grounded"), relevant.alias("relevant")), F.col("grounded"), "grounded_reply")
            both = ask(both, F.col("relevant"), "relevant_reply").select("query_id", "grounded_reply", "relevant_reply")
            got.triad = triad.evaluate(queries, relevance, both)
        return got
