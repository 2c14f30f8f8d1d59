"""python -m corpusquery.plans.cli (basic | hybrid | graph) --data FILE [--query TEXT]: one question, or questions until exit, quit or q."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import bar, label, snippet
from ..operators import answers, graph
from ..sources.graph_store import GraphStore
from ..sources.textfile import check_chunks, read_text
from .config import BACKENDS, Config
from .pipelines import Basic, Hybrid


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("kind", choices=("basic", "hybrid", "graph"))
    p.add_argument("--data", required=True)
    p.add_argument("--query")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--top-k", type=int)
    p.add_argument("--top-k-sparse", type=int)
    p.add_argument("--top-k-dense", type=int)
    p.add_argument("--top-n", type=int)
    p.add_argument("--backend", choices=BACKENDS)
    p.add_argument("--rrf-k", type=int)
    for name in ("k1", "b", "delta"):
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--mode", choices=graph.MODES, default="hybrid")
    return p


def _shown(title: str, ranked, chunks, score: str) -> list[str]:
    """How many there are, and the first five."""
    count = ranked.count()
    rows = ranked.join(chunks.select("chunk_id", "text"), "chunk_id").filter("rank <= 5").orderBy("rank").select("rank", "chunk_id", score, snippet(F.col("text"), 90, always=True).alias("s")).collect()
    return [f"{title}: {count}", *(f"  {r[0]}. [{r[2]:.4f}] ({r[1]}) {r[3]}" for r in rows)]


def ask(spark: SparkSession, args, built, question: str) -> list[str]:
    queries = spark.createDataFrame([(0, question)], "query_id long, text string")
    if args.kind == "graph":
        chunks, g, basic = built
        remote = basic.config.model_url
        embedder = basic.embedder if remote else None
        keywords = graph.levels(queries, lambda: graph.ModelKeywords(basic.model())) if remote else None
        found = graph.search(g, queries, args.mode, args.top_k, naive=basic.retrieve, embedder=embedder, keywords=keywords)
        out = _shown(f"Chunks ({args.mode})", found, chunks, "score") if args.debug else []
        if args.mode == "naive":
            return [*out, "Answer:", basic.query(queries, args.top_k).answers.first()["answer"]]
        context = answers.contexts(g, queries, chunks, args.mode, args.top_k or 5, embedder, keywords=keywords)
        return [*out, "Answer:", answers.answered(context, basic.model).first()["answer"]]
    if args.kind == "basic":
        got = built.query(queries, args.top_k)
        out = _shown("Nearest chunks", got.dense, built.chunks, "score") if args.debug else []
        return [*out, "Answer:", got.answers.first()["answer"]]
    got = built.query(queries, top_k_sparse=args.top_k_sparse, top_k_dense=args.top_k_dense, top_n=args.top_n, rrf_k=args.rrf_k)
    out = []
    if args.debug:
        for title, rows, score in (("BM25L", got.sparse, "score"), ("Vectors", got.dense, "score"), ("Fused", got.fused, "rrf_score"), ("Reranked", got.reranked, "rerank_score")):
            out += _shown(title, rows, built.chunks, score)
    out += ["Answer:", got.answers.first()["answer"]]
    if got.triad is not None:
        names = ("context_relevance", "groundedness", "answer_relevance", "composite")
        row = got.triad.select(*(F.concat_ws(" ", bar(F.col(c)), F.format_string("%.2f", c), label(F.col(c))).alias(c) for c in names)).first()
        out += [f"  {c}: {row[c]}" for c in names]
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = read_text(spark, args.data)
    config = Config(**{name: getattr(args, name) for name in ("backend", "k1", "b", "delta") if getattr(args, name) is not None})
    if args.kind == "graph":
        basic = Basic(docs, config=config)
        chunks, model = basic.chunks, config.model()
        check_chunks(chunks, args.data)
        store = GraphStore(spark, config.graph_dir)
        store.insert(docs, (lambda: graph.ModelExtractor(model())) if config.model_url else None, config.chunk_size, config.chunk_overlap)
        g = store.graph((lambda: graph.ModelSummariser(model())) if config.model_url else None).kept()
        built = store.chunks(), g.embedded(basic.embedder) if config.model_url else g, basic
    else:
        built = {"basic": Basic, "hybrid": Hybrid}[args.kind](docs, config=config)
        chunks = built.chunks
        check_chunks(chunks, args.data)
    print(f"{chunks.count()} chunks of {docs.count()} documents indexed")
    if args.query:
        print("\n".join(ask(spark, args, built, args.query)))
        return
    while True:
        try:
            question = input("? ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if question.lower() in ("exit", "quit", "q"):
            return
        if question:
            print("\n".join(ask(spark, args, built, question)))


if __name__ == "__main__":
    main()
