"""The engine's own queries over the test tables, each with its SQL where SQL can express it.

Documents have single line feeds only, so paragraphs are made by doubling them; chunk ids start with the document's id.
Benchmark items are the queries; of the vectors, every one whose id is divisible by 20 is a query; eight vectors in a row make
a document of tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .functions import scores as score_functions
from .functions import text as T
from .operators import answers, clustered, dense, fusion, graph, inverted, prompts, rerank, sparse, triad
from .operators.chunking import chunk
from .operators.ranking import top_k
from .plans.config import Config
from .plans.pipelines import Basic, Hybrid
from .sources.graph_store import GraphStore
from .sources.stores import VectorStore
from .sources.tables import drop, materialise, own_dir

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"
#: Line ends of any kind and quotes, which would end a value assigned on one line.
_LINE_OR_QUOTE = r"""[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"']"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words with an underscore or a Latin-1 letter go as a whole before tokens are taken.
_TOKENS = r"regexp_extract_all(regexp_replace(lower({0}), '[a-z0-9_]*[_ßà-öø-ÿ][a-z0-9_ßà-öø-ÿ]*', ' ', 'g'), '\b[a-z0-9]+(?:-[a-z0-9]+)*\b')"
#: Runs of letters and digits with hyphens between them.
_RUN = r"[\p{L}\p{Nd}_]+(?:-[\p{L}\p{Nd}_]+)*"
_CHUNKS = f"""
para AS (SELECT doc_id, pi, trim(p, {_WS}) AS p FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM
  (SELECT doc_id, string_split(replace(trim(text, {_WS}), chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents)) WHERE trim(p, {_WS}) <> ''),
win AS (SELECT doc_id, pi, s, trim(substr(p, s + 1, 400), {_WS}) AS piece FROM
  (SELECT doc_id, pi, p, unnest(CASE WHEN length(p) <= 400 THEN [0] ELSE range(0, (ceil((length(p) - 400) / 340.0) * 340)::BIGINT + 1, 340) END) AS s FROM para)),
chunks AS (SELECT doc_id, idx, printf('%d#chunk-%04d', doc_id, idx) AS chunk_id, piece AS text FROM
  (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY pi, s) - 1 AS idx FROM win WHERE piece <> ''))"""
_SPARSE = f"""{_CHUNKS},
toks AS (SELECT chunk_id, {_TOKENS.format("text")} AS ts FROM chunks),
posts AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY 1, 2, 3),
terms AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
stats AS (SELECT count(*) AS n, sum(len(ts)) / greatest(1, count(*)) AS avgdl FROM toks)"""
_BM25 = f"""{_SPARSE},
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, round(sum(qtf * (ln(n + 1) - ln(df + 0.5)) * 2.5 * (ctd + 0.5) / (1.5 + ctd + 0.5)), 6) AS score FROM
  (SELECT query_id, chunk_id, qtf, n, df, tf / (0.25 + 0.75 * dl / greatest(1.0, avgdl)) AS ctd FROM qt JOIN posts USING (term) JOIN terms USING (term), stats) GROUP BY 1, 2),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 5)"""
_COSINE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
dense AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, floor(list_cosine_similarity(q.e, v.e) * 1e6 + 0.5) / 1e6 AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY floor(list_cosine_similarity(q.e, v.e) * 1e6 + 0.5) / 1e6 DESC, v.vec_id)::INT AS rank FROM v, v q WHERE q.vec_id % 20 = 0 QUALIFY rank <= {k})"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.replace(T.strip(F.col("text")), F.lit("\n"), F.lit("\n\n")).alias("text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(_docs(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def chunks_basic(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "source", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_length").cast("long").alias("char_length"), "text")


def chunks_assigned(spark, sf_dir):
    """Every document's whole text on one line; a null text is an empty value."""
    value = F.regexp_replace(F.coalesce("text", F.lit("")), _LINE_OR_QUOTE, " ")
    text = F.concat_ws("", F.lit("documents = [\nD1 = \""), value, F.lit("\"\nX = \"\"\nplain line"), F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), text.alias("text"))
    return chunk(docs, assignments=True).select("chunk_id", "text")


def snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("short"), T.snippet(F.col("text"), 90, always=True).alias("shown"))


def tokenised(spark, sf_dir):
    """A digest of all tokens."""
    ts = T.tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.md5(F.array_join(ts, " ")).alias("digest"))


def corpus_stats(spark, sf_dir):
    ix = sparse.index(_chunks(spark, sf_dir))
    return ix.stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def term_stats(spark, sf_dir):
    ix = sparse.index(_chunks(spark, sf_dir)).kept()
    return ix.terms.crossJoin(F.broadcast(ix.stats)).select("term", "df", "cf", F.round(sparse.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_top5(spark, sf_dir):
    return sparse.search(sparse.index(_chunks(spark, sf_dir)), _asked(spark, sf_dir), 5, digits=6)


def inverted_top5(spark, sf_dir):
    """The same from an index of postings on disk, in two parts."""
    ix = sparse.index(_chunks(spark, sf_dir)).kept()
    stored = inverted.InvertedIndex(spark, f"{own_dir(spark)}/postings-{uuid.uuid4().hex}")
    for odd in (0, 1):
        stored.add(sparse.SparseIndex(ix.documents.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == odd)))
    drop(ix.documents)
    return stored.search(_asked(spark, sf_dir), 5, digits=6)


def vector_norms(spark, sf_dir):
    return dense.indexed(_vectors(spark, sf_dir)).select("chunk_id", F.round("norm", 6).alias("norm"))


def cosine_top5(spark, sf_dir):
    return dense.cosine_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 5, digits=6)


def pruned_top5(spark, sf_dir):
    """The same from vectors stored in clusters, of which only those are read that can hold one of the nearest."""
    stored = clustered.Clusters.write(_vectors(spark, sf_dir), f"{own_dir(spark)}/clusters-{uuid.uuid4().hex}")
    return stored.search(_vector_queries(spark, sf_dir), 5, digits=6)


def maxsim_top5(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("chunk_id"), (F.col("vec_id") % 8).cast("int").alias("token_pos"), "embedding")
    docs = materialise(dense.token_arrays(rows), "token_arrays")
    return dense.maxsim_search(docs, docs.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 5, digits=6)


def _fused(spark, sf_dir):
    """A dense and a sparse list over the same ids, from the vectors: near ones, and those of the same label by id. The latter are the same for each query of a label, so they are cut to 5 before the join."""
    rows = _table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("chunk_id"), (1.0 / (1 + F.col("vec_id"))).alias("score"))
    asked = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = asked.join(top_k(rows, 5, F.desc("score"), F.col("chunk_id"), by="label"), "label").select("query_id", "chunk_id", "score", "rank")
    return fusion.fuse(cosine_top5(spark, sf_dir), same)


def rrf_fusion(spark, sf_dir):
    return fusion.rounded(_fused(spark, sf_dir))


def rerank_replies(spark, sf_dir):
    """Replies rate the candidates 0 and 2; those of every fourth query can't be parsed."""
    fused, n = _fused(spark, sf_dir), F.floor(F.col("query_id") / 20)
    reply = F.when(n % 4 == 3, "no scores").otherwise(F.format_string('```json\n[{"index": 0, "score": %d}, {"index": 2, "score": "7.5"}]\n```', n % 10))
    out = rerank.rerank(fused, fused.select("query_id").distinct().withColumn("reply", reply), 3)
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "original_rank", "rerank_source", "rank")


def _bypass(fused):
    out = rerank.rerank(fused, fused.select("query_id", F.lit(None).cast("string").alias("reply")).distinct(), 3)
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "original_rank", "rerank_source", "rank")


def rerank_bypass(spark, sf_dir):
    return _bypass(_fused(spark, sf_dir))


def clamped(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("value") / 50.0 - 0.5).alias("x"))
    score = score_functions.clamp(F.col("x"))
    return rows.select("event_id", F.round(score, 6).alias("score"), T.bar(F.round(score, 6)).alias("bar"), T.label(F.round(score, 6)).alias("label"))


def unfenced(spark, sf_dir):
    """Whole texts in a fence."""
    text = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.unfenced(text).alias("inner_text"))


def reply_scores(spark, sf_dir):
    """Replies of each kind; those without JSON are whole texts, whose digits are left out so that the number behind them is the first."""
    d, told = F.col("doc_id"), F.regexp_replace("text", "[0-9]", "")
    reply = F.when(d % 6 == 0, F.format_string('{"score": 0.%02d}', d % 100)).when(d % 6 == 1, F.format_string('```json\n{"score": "0.%02d"}\n```', d % 100)).when(d % 6 == 2, F.concat(told, F.format_string(" about %d/10", d % 10))).when(d % 6 == 3, told).when(d % 6 == 4, F.lit('{"score": 1.5}')).otherwise(F.lit('{"score": -0.2}'))
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(score_functions.extract_score(reply, F.lit(0.5)), 6).alias("score"))


def reply_rankings(spark, sf_dir):
    """Replies that quote the whole text of an item."""
    reply = F.format_string('[{"index": 0, "score": %d, "why": %s}, {"no": 1}, {"index": 1, "score": "2.5"}]', F.col("item_id"), F.to_json(F.array("text")))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(score_functions.extract_ranking(reply)).alias("r"))
    return rows.select("item_id", "r.index", "r.score")


def answer_prompts(spark, sf_dir):
    ranked = bm25_top5(spark, sf_dir).filter("rank <= 3").join(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    rows = prompts.ordered_texts(ranked).join(_asked(spark, sf_dir), "query_id")
    return rows.select("query_id", prompts.answer(F.col("results"), F.col("text"), "Document Chunk").alias("answer"), prompts.rerank(F.col("results"), F.col("text")).alias("rerank"))


def judge_prompts(spark, sf_dir):
    """The whole text is the answer."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.concat(F.lit("  "), "text", F.lit("\n"))
    return rows.select(
        "doc_id", F.md5(prompts.context_relevance(F.lit(" what? "), text)).alias("relevance"), F.md5(prompts.groundedness(F.array(text, F.lit("more")), F.lit(" so "))).alias("grounded"), F.md5(prompts.answer_relevance(F.lit(" what? "), text)).alias("answer")
    )


def chat_prompts(spark, sf_dir):
    talk = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    history = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return talk.select("conv_id", prompts.flattened_chat(F.lit("And now?"), history, F.when(F.col("conv_id") % 2 == 0, "Be brief.")).alias("prompt"))


def triad_scores(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    chunks = asked.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).filter("query_id % 4 <> 3").select("query_id", F.when(F.col("i") == 2, None).otherwise(F.format_string('{"score": 0.%d}', (F.col("query_id") + F.col("i")) % 10)).alias("reply"))
    both = asked.filter("query_id % 5 <> 4").select("query_id", F.format_string("score 0.%d", F.col("query_id") % 10).alias("grounded_reply"), F.lit("1").alias("relevant_reply"))
    return triad.rounded(triad.evaluate(asked, chunks, both))


def _graph(spark, sf_dir):
    return graph.extract(_chunks(spark, sf_dir).select("chunk_id", "text"))


def graph_tables(spark, sf_dir):
    """Entities and relations of the graph, one above the other."""
    g = graph.extract(_chunks(spark, sf_dir).select("chunk_id", "text"))
    return g.entities.select("name", F.lit("").alias("other"), "type", "mentions", "n_chunks").union(g.relations.select("src", "dst", F.array_join("keywords", " "), "mentions", "n_chunks"))


def graph_search(spark, sf_dir):
    return graph.search(_graph(spark, sf_dir), _asked(spark, sf_dir), "hybrid", 5)


def graph_local(spark, sf_dir):
    return graph.search(_graph(spark, sf_dir), _asked(spark, sf_dir), "local", 5)


def graph_global(spark, sf_dir):
    return graph.search(_graph(spark, sf_dir), _asked(spark, sf_dir), "global", 5)


def graph_nearest(spark, sf_dir):
    """Both ways, by the nearest entities and relations."""
    return graph.search(_graph(spark, sf_dir), _asked(spark, sf_dir), "hybrid", 5, embedder=providers.LetterEmbedder, digits=6)


def graph_keywords(spark, sf_dir):
    """Entities by the questions' names, relations by their other words, from stored vectors."""
    asked = _asked(spark, sf_dir)
    g = _graph(spark, sf_dir).embedded(providers.LetterEmbedder).write(f"{own_dir(spark)}/graph-{uuid.uuid4().hex}")
    return graph.search(g, asked, "hybrid", 5, embedder=providers.LetterEmbedder, digits=6, keywords=graph.levels(asked))


def graph_answers(spark, sf_dir):
    """Answers from entities, relations and passages, each under a budget of words, from a graph that documents were added to in two parts."""
    store, asked = GraphStore(spark, f"{own_dir(spark)}/graph-{uuid.uuid4().hex}"), _asked(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    for odd in (0, 1):
        store.insert(docs.filter(F.pmod(F.xxhash64("source"), F.lit(2)) == odd))
    found = answers.contexts(store.graph().kept(), asked, store.chunks(), "hybrid", 8, providers.LetterEmbedder, 10, 6, graph.levels(asked), answers.Budget(60, 60, 300, 40))
    got = answers.answered(found, providers.ExtractiveModel)
    return got.select("query_id", "n_entities", "n_relations", "n_passages", F.md5("entities").alias("entities"), F.md5("relations").alias("relations"), F.md5("prompt").alias("prompt"), "answer")


#: Scores to six places, so that equal ones are equal in SQL as well.
_CONFIG = {"backend": "single", "score_digits": 6, "top_k": 3, "top_k_sparse": 5, "top_k_dense": 5, "rrf_k": 60, "top_n_rerank": 3, "evaluate": True}


def _basic(spark, sf_dir):
    return Basic(_docs(spark, sf_dir), providers.LetterEmbedder, providers.ExtractiveModel, Config(**_CONFIG))


def graph_naive(spark, sf_dir):
    return graph.search(None, _asked(spark, sf_dir), "naive", 5, naive=_basic(spark, sf_dir).retrieve)


def basic_answers(spark, sf_dir):
    got = _basic(spark, sf_dir).query(_asked(spark, sf_dir))
    return got.answers.select("query_id", F.array_join(F.transform("results", lambda r: r["chunk_id"]), " ").alias("chunk_ids"), "answer")


def hybrid_answers(spark, sf_dir):
    got = Hybrid(_docs(spark, sf_dir), providers.LetterEmbedder, providers.ExtractiveModel, Config(**_CONFIG)).query(_asked(spark, sf_dir))
    return got.answers.select("query_id", F.array_join(F.transform("results", lambda r: r["chunk_id"]), " ").alias("chunk_ids"), "answer").join(got.triad, "query_id")


def judged_answers(spark, sf_dir):
    """Reranked, answered and judged by a model that reads: it rates by shared words."""
    got = Hybrid(_docs(spark, sf_dir), providers.LetterEmbedder, providers.OverlapModel, Config(**_CONFIG)).query(_asked(spark, sf_dir))
    ranked = got.reranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("rerank_score", 6).alias("s"), "original_rank"))).alias("r"))
    told = F.array_join(F.transform("r", lambda x: F.format_string("%s:%.1f:%d", x["chunk_id"], x["s"], x["original_rank"])), " ").alias("ranked")
    return got.answers.select("query_id", "answer").join(ranked.select("query_id", told), "query_id", "left").join(triad.rounded(got.triad), "query_id")


def answer_prompts_basic(spark, sf_dir):
    """Benchmark items that no chunk answers get the fixed answer, the others a prompt."""
    ranked = bm25_top5(spark, sf_dir).filter("rank <= 2 AND query_id % 3 <> 0").join(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    rows = _asked(spark, sf_dir).join(prompts.ordered_texts(ranked), "query_id", "left").withColumn("results", F.coalesce("results", F.array()))
    return rows.select("query_id", F.coalesce(prompts.answer(F.col("results"), F.col("text")), F.lit(prompts.NO_CONTEXT)).alias("prompt"))


def chunk_metadata(spark, sf_dir):
    """Extra metadata: the fixed keys win over those of the same name."""
    docs = _table(spark, sf_dir, "documents").withColumn("extra", F.create_map(F.lit("lang"), "lang", F.lit("source"), F.lit("other"), F.lit("chunk_index"), F.lit("-1")))
    text = F.replace(T.strip(F.col("text")), F.lit("\n"), F.lit("\n\n")).alias("text")
    rows = chunk(docs.select(F.col("doc_id").cast("string").alias("source"), text, "extra"), extra="extra")
    return rows.select("chunk_id", "source", F.array_join(F.array_sort(F.map_keys("extra")), " ").alias("extra_keys"), F.col("extra")["lang"].alias("lang"))


def stored_vectors(spark, sf_dir):
    """Vectors through the store: cleared, added in two parts, some of them again with other values."""
    store = VectorStore(spark, f"{own_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    store.add(rows.select("chunk_id"), rows)
    store.clear()
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1", "vec_id % 10 = 0"):
        some = _table(spark, sf_dir, "embeddings").filter(part).select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
        if part.startswith("vec_id % 10"):
            some = some.withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
        store.add(some.select("chunk_id"), some)
    return store.read().select("chunk_id", F.round("norm", 6).alias("norm"))


def counts(spark, sf_dir):
    """Chunks of each document, for display."""
    return _chunks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("char_length").alias("n_chars"))


_LABELLED = """
same AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 1.0 / (1 + v.vec_id) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id)::INT AS rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5),
fused AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + d.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + s.rank), 0.0)::DOUBLE AS rrf_score, coalesce(s.rank, -1) AS sparse_rank, coalesce(s.score, 0.0)::DOUBLE AS sparse_score,
  coalesce(d.rank, -1) AS dense_rank, coalesce(d.score, 0.0)::DOUBLE AS dense_score FROM dense d FULL JOIN same s USING (query_id, chunk_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank < 0, dense_rank, sparse_rank)::INT AS rank FROM fused)"""
_FUSED = "WITH " + _COSINE.format(k=5) + "," + _LABELLED


def _prompt_sql(template: str, *parts: str) -> str:
    """A prompt's template with SQL expressions in place of its %s."""
    texts = template.split("%s")
    quoted = ["'" + t.replace("'", "''") + "'" for t in texts]
    return " || ".join(x for pair in zip(quoted, [*parts, None]) for x in pair if x)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strip_sql(x: str) -> str:
    return f"trim({x}, {_WS})"


_DOC = "('  ' || text || chr(10))"
QUERIES = {
    "c1_c9_chunks": chunks_basic,
    "c4_c5_assignment_chunks": chunks_assigned,
    "c10_c11_snippets": snippets,
    "s1_tokens": tokenised,
    "d1_corpus_stats": corpus_stats,
    "d2_d3_s4_term_stats": term_stats,
    "k1_d4_j3_bm25_top5": bm25_top5,
    "a9_k1_j3_inverted_top5": inverted_top5,
    "s7_a7_vector_norms": vector_norms,
    "k2_j1_s8_cosine_top5": cosine_top5,
    "k2_j1_pruned_top5": pruned_top5,
    "k3_j2_d5_d6_maxsim_top5": maxsim_top5,
    "f1_j4_k4_d7_a13_rrf_fusion": rrf_fusion,
    "r1_j5_k5_s18_rerank": rerank_replies,
    "k6_rerank_bypass": rerank_bypass,
    "s11_s14_s15_scores": clamped,
    "s12_code_fence": unfenced,
    "s13_s17_reply_scores": reply_scores,
    "s18_reply_rankings": reply_rankings,
    "p1_p2_p4_d10_prompts": answer_prompts,
    "p5_p7_s16_judge_prompts": judge_prompts,
    "p8_chat_prompts": chat_prompts,
    "e1_d8_d9_triad": triad_scores,
    "p1_p3_basic_prompts": answer_prompts_basic,
    "c9_chunk_metadata": chunk_metadata,
    "a7_a10_u1_vector_store": stored_vectors,
    "d11_counts": counts,
    "g1_graph_tables": graph_tables,
    "g2_graph_naive": graph_naive,
    "g3_g4_graph_nearest": graph_nearest,
    "g3_g4_graph_keywords": graph_keywords,
    "g6_graph_answers": graph_answers,
    "g3_graph_local": graph_local,
    "g4_graph_global": graph_global,
    "g1_g5_graph_hybrid": graph_search,
    "q1_q2_basic_answers": basic_answers,
    "q3_q4_hybrid_answers": hybrid_answers,
    "q4_r1_e1_judged_answers": judged_answers,
}
SQL = {
    "c1_c9_chunks": f"WITH {_CHUNKS} SELECT chunk_id, doc_id::VARCHAR AS source, idx AS chunk_index, length(text) AS char_length, text FROM chunks",
    "c4_c5_assignment_chunks": f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), {_quoted(_LINE_OR_QUOTE)}, ' ', 'g'), {_WS}) AS p FROM documents),
win AS (SELECT doc_id, s, trim(substr(p, s + 1, 400), {_WS}) AS piece FROM
  (SELECT doc_id, p, unnest(CASE WHEN length(p) <= 400 THEN [0] ELSE range(0, (ceil((length(p) - 400) / 340.0) * 340)::BIGINT + 1, 340) END) AS s, length(p) AS n FROM d) WHERE n <= 400 OR trim(substr(p, s + 1, 400), {_WS}) <> ''),
parts AS (SELECT doc_id, 0 AS line, s, piece FROM win UNION ALL SELECT doc_id, 1, 0, '' FROM d UNION ALL SELECT doc_id, 2, 0, 'plain line' || doc_id FROM d)
SELECT printf('%d#chunk-%04d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, s) - 1) AS chunk_id, piece AS text FROM parts""",
    "c10_c11_snippets": "SELECT doc_id, replace(substr(text, 1, 60), chr(10), ' ') || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS short, replace(substr(text, 1, 90), chr(10), ' ') || '...' AS shown FROM documents",
    "s1_tokens": f"SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents)",
    "d1_corpus_stats": f"WITH {_SPARSE} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "d2_d3_s4_term_stats": f"WITH {_SPARSE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln(any_value(n) + 1) - ln(count(*) + 0.5), 6) AS idf FROM posts, stats GROUP BY 1",
    "k1_d4_j3_bm25_top5": f"WITH {_BM25} SELECT * FROM sparse",
    "a9_k1_j3_inverted_top5": f"WITH {_BM25} SELECT * FROM sparse",
    "s7_a7_vector_norms": "SELECT vec_id AS chunk_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings",
    "k2_j1_s8_cosine_top5": f"WITH {_COSINE.format(k=5)} SELECT * FROM dense",
    "k2_j1_pruned_top5": f"WITH {_COSINE.format(k=5)} SELECT * FROM dense",
    "k3_j2_d5_d6_maxsim_top5": """
WITH v AS (SELECT vec_id // 8 AS d, vec_id % 8 AS pos, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT q.d AS query_id, v.d AS chunk_id, q.pos, max(list_cosine_similarity(q.e, v.e)) AS s FROM v q JOIN v ON q.d % 20 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_id, chunk_id, floor(sum(s) * 1e6 + 0.5) / 1e6 AS score FROM m GROUP BY 1, 2)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    "f1_j4_k4_d7_a13_rrf_fusion": f"{_FUSED} SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, sparse_rank, round(sparse_score, 6) AS sparse_score, dense_rank, round(dense_score, 6) AS dense_score, rank FROM ordered",
    "r1_j5_k5_s18_rerank": f"""{_FUSED},
r AS (SELECT query_id, chunk_id, rank AS original_rank, CASE WHEN query_id // 20 % 4 = 3 THEN rrf_score WHEN rank = 1 THEN (query_id // 20 % 10)::DOUBLE WHEN rank = 3 THEN 7.5 ELSE rrf_score * 10 END AS s, CASE WHEN query_id // 20 % 4 = 3 THEN 'fusion' ELSE 'model' END AS rerank_source FROM ordered)
SELECT query_id, chunk_id, round(s, 6) AS rerank_score, original_rank, rerank_source, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id // 20 % 4 = 3 THEN 0 ELSE s END DESC, original_rank)::INT AS rank FROM r QUALIFY rank <= 3""",
    "k6_rerank_bypass": f"{_FUSED} SELECT query_id, chunk_id, round(rrf_score, 6) AS rerank_score, rank AS original_rank, 'fusion' AS rerank_source, rank FROM ordered WHERE rank <= 3",
    "s11_s14_s15_scores": """
WITH s AS (SELECT event_id, round(greatest(0.0, least(1.0, value / 50.0 - 0.5)), 6) AS score FROM events), b AS (SELECT *, round_even(score * 10, 0)::INT AS n FROM s)
SELECT event_id, score, repeat('█', n) || repeat('░', 10 - n) AS bar, CASE WHEN score >= 0.8 THEN 'pass' WHEN score >= 0.5 THEN 'warn' ELSE 'fail' END AS label FROM b""",
    "s12_code_fence": f"SELECT doc_id, trim(text, {_WS}) AS inner_text FROM documents",
    "s13_s17_reply_scores": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN round((doc_id % 100) / 100.0, 6) WHEN 1 THEN round((doc_id % 100) / 100.0, 6) WHEN 2 THEN least(1, doc_id % 10)::DOUBLE WHEN 3 THEN 0.5 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents""",
    "s18_reply_rankings": "SELECT item_id, 0 AS index, item_id::DOUBLE AS score FROM benchmark UNION ALL SELECT item_id, 1, 2.5::DOUBLE FROM benchmark",
    "p1_p2_p4_d10_prompts": f"""
WITH {_BM25},
c AS (SELECT query_id, string_agg('[Document Chunk ' || rank || ' - ID: ' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks,
  string_agg('[' || (rank - 1) || '] ' || replace(text, chr(10), ' '), chr(10) ORDER BY rank) AS lines FROM sparse JOIN chunks USING (chunk_id) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, {_prompt_sql(prompts._ANSWER, "blocks", "text")} AS answer, {_prompt_sql(prompts._RERANK, "text", "lines")} AS rerank FROM c JOIN benchmark ON item_id = query_id""",
    "p5_p7_s16_judge_prompts": f"""
SELECT doc_id, md5({_prompt_sql(prompts._CONTEXT_RELEVANCE, "'what?'", f"substr({_strip_sql(_DOC)}, 1, 1500)")}) AS relevance,
  md5({_prompt_sql(prompts._GROUNDEDNESS, _strip_sql(f"substr({_DOC} || chr(10) || chr(10) || 'more', 1, 3000)"), "'so'")}) AS grounded,
  md5({_prompt_sql(prompts._ANSWER_RELEVANCE, "'what?'", _strip_sql(_DOC))}) AS answer FROM documents""",
    "p8_chat_prompts": """
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'And now?' AS prompt FROM conversations GROUP BY 1""",
    "e1_d8_d9_triad": """
WITH s AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 THEN 0.5::DOUBLE ELSE ((item_id % 10) / 10.0 + ((item_id + 1) % 10) / 10.0 + 0.5) / 3 END AS c,
  CASE WHEN item_id % 5 = 4 THEN 0.5::DOUBLE ELSE (item_id % 10) / 10.0 END AS g, CASE WHEN item_id % 5 = 4 THEN 0.5::DOUBLE ELSE 1.0 END AS a FROM benchmark)
SELECT query_id, round_even(c::DOUBLE, 4) AS context_relevance, round_even(g::DOUBLE, 4) AS groundedness, round_even(a::DOUBLE, 4) AS answer_relevance, round_even(((c + g + a) / 3)::DOUBLE, 4) AS composite FROM s""",
}
_GRAPH = f"""{_CHUNKS},
runs AS (SELECT chunk_id, list_filter(regexp_extract_all(text, '{_RUN}'), lambda x: regexp_matches(x, '{graph.NAME}')) AS raw FROM chunks),
named AS (SELECT chunk_id, list_transform(raw, lambda x: lower(x)) AS names FROM runs),
nodes AS (SELECT name, chunk_id, count(*) AS n FROM (SELECT chunk_id, unnest(names) AS name FROM named) GROUP BY 1, 2),
pairs AS (SELECT chunk_id, unnest(list_transform(range(1, len(names)), lambda i: {{'src': least(names[i], names[i + 1]), 'dst': greatest(names[i], names[i + 1])}})) AS p FROM named),
edges AS (SELECT p.src AS src, p.dst AS dst, chunk_id, count(*) AS n FROM pairs WHERE p.src <> p.dst GROUP BY 1, 2, 3),
asked AS (SELECT DISTINCT query_id, lower(name) AS name FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(text, '{_RUN}'), lambda x: regexp_matches(x, '{graph.NAME}'))) AS name FROM benchmark)),
seeds AS (SELECT query_id, name, 1.0::DOUBLE AS w FROM asked WHERE name IN (SELECT name FROM nodes)),
ends AS (SELECT DISTINCT src AS name, dst AS other FROM edges UNION SELECT dst, src FROM edges),
weights AS (SELECT query_id, name, max(w) AS w FROM (SELECT * FROM seeds UNION ALL SELECT query_id, other, 0.5 FROM seeds JOIN ends USING (name)) GROUP BY 1, 2),
near AS (SELECT query_id, chunk_id, sum(w * n)::DOUBLE AS score FROM weights JOIN nodes USING (name) GROUP BY 1, 2),
wide AS (SELECT query_id, chunk_id, sum(n)::DOUBLE AS score FROM asked JOIN (SELECT src AS name, chunk_id, n FROM edges UNION ALL SELECT dst, chunk_id, n FROM edges) USING (name) GROUP BY 1, 2),
mixed AS (SELECT query_id, chunk_id, sum(score)::DOUBLE AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM wide) GROUP BY 1, 2)"""
_BEST = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {} QUALIFY rank <= 5"
#: Letter counts as vectors, and their cosines to six places.
_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (len({0}) - len(replace({0}, c, '')))::DOUBLE)"
_LOW = f"translate(text, '{_UPPER}', lower('{_UPPER}'))"
_NEAREST = f"""
cv AS (SELECT chunk_id, {_LETTERS.format("t")} AS v FROM (SELECT chunk_id, {_LOW} AS t FROM chunks)),
qv AS (SELECT query_id, {_LETTERS.format("t")} AS v FROM (SELECT item_id AS query_id, {_LOW} AS t FROM benchmark)),
cn AS (SELECT chunk_id, v, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 1e-10 ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END AS size FROM cv),
qn AS (SELECT query_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM qv),
cos AS (SELECT query_id, chunk_id, floor(list_dot_product(cn.v, qn.v) / (cn.size * qn.size) * 1e6 + 0.5) / 1e6 AS score FROM cn, qn WHERE qn.size > 0),
near AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM cos QUALIFY rank <= 5)"""
#: The ten nearest entities (by {low}) and relations (by {high}) of each query by letter counts, and what they lead to, in halves of a millionth.
_VECTOR = "{0} AS v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size"
_TEN = "floor(list_dot_product({0}.v, q.v) / (CASE WHEN {0}.size = 0 THEN 1e-10 ELSE {0}.size END * q.size) * 1e6 + 0.5) / 1e6"
_NEAR_GRAPH = f"""
kind AS (SELECT name, CASE WHEN contains(name, '-') THEN 'code' ELSE 'word' END AS type, sum(n)::BIGINT AS mentions FROM nodes GROUP BY 1),
rel AS (SELECT src, dst, sum(n)::BIGINT AS mentions FROM edges GROUP BY 1, 2),
env AS (SELECT name, {_VECTOR.format(_LETTERS.format("t"))} FROM (SELECT name, translate(name || ' ' || type, '{_UPPER}', lower('{_UPPER}')) AS t FROM kind)),
rev AS (SELECT src, dst, {_VECTOR.format(_LETTERS.format("t"))} FROM (SELECT src, dst, src || dst || src || dst AS t FROM rel)),
lowv AS (SELECT query_id, {_VECTOR.format(_LETTERS.format("t"))} FROM (SELECT query_id, translate(low, '{_UPPER}', lower('{_UPPER}')) AS t FROM levels)),
highv AS (SELECT query_id, {_VECTOR.format(_LETTERS.format("t"))} FROM (SELECT query_id, translate(high, '{_UPPER}', lower('{_UPPER}')) AS t FROM levels)),
nearest AS (SELECT query_id, name, {_TEN.format("env")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_TEN.format("env")} DESC, name) AS rank FROM env, lowv q WHERE q.size > 0 QUALIFY rank <= 10),
first AS (SELECT query_id, name, round(score * 1e6)::BIGINT AS w FROM nearest WHERE score > 0),
hood AS (SELECT query_id, name, max(w2) AS w2 FROM (SELECT query_id, name, 2 * w AS w2 FROM first UNION ALL SELECT query_id, other, w FROM first JOIN ends USING (name)) GROUP BY 1, 2),
closest AS (SELECT query_id, src, dst, {_TEN.format("rev")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_TEN.format("rev")} DESC, '["' || src || '","' || dst || '"]') AS rank FROM rev, highv q WHERE q.size > 0 QUALIFY rank <= 10),
tied AS (SELECT query_id, src, dst, round(score * 1e6)::BIGINT AS w FROM closest WHERE score > 0),
tips AS (SELECT query_id, name, max(w) AS w FROM (SELECT query_id, src AS name, w FROM tied UNION ALL SELECT query_id, dst, w FROM tied) GROUP BY 1, 2),
shares AS (SELECT query_id, chunk_id, w2 * n AS s FROM hood JOIN nodes USING (name) UNION ALL SELECT query_id, chunk_id, 2 * w * n FROM tied JOIN edges USING (src, dst) UNION ALL SELECT query_id, chunk_id, w * n FROM tips JOIN nodes USING (name)),
by_graph AS (SELECT query_id, chunk_id, sum(s)::DOUBLE / 2e6 AS score FROM shares GROUP BY 1, 2)"""
_QUESTION = "levels AS (SELECT item_id AS query_id, text AS low, text AS high FROM benchmark)"
#: Names of a question as the low level, its tokens that aren't in a name as the high one; the question itself where a level is empty.
_LEVELS = f"""
said AS (SELECT item_id AS query_id, text, list_transform(list_filter(regexp_extract_all(text, '{_RUN}'), lambda x: regexp_matches(x, '{graph.NAME}')), lambda x: lower(x)) AS names, {_TOKENS.format("text")} AS ts FROM benchmark),
levels AS (SELECT query_id, CASE WHEN len(names) > 0 THEN array_to_string(names, ' ') ELSE text END AS low, CASE WHEN len(rest) > 0 THEN array_to_string(rest, ' ') ELSE text END AS high FROM
  (SELECT *, list_filter(ts, lambda t: NOT list_contains(names, t) AND NOT list_contains(flatten(list_transform(names, lambda x: regexp_split_to_array(x, '[-_]'))), t)) AS rest FROM said))"""
_WORDS = "len(regexp_extract_all({0}, '[^ \\t\\n\\r]+'))"
_GRAPH_ANSWERS = f"""
el AS (SELECT query_id, name || ' (' || type || ')' AS line, row_number() OVER (PARTITION BY query_id ORDER BY w2 DESC, mentions DESC, name) AS rank FROM hood JOIN kind USING (name) QUALIFY rank <= 40),
eb AS (SELECT query_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS t FROM (SELECT *, sum({_WORDS.format("line")}) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM el) WHERE so_far <= 60 GROUP BY 1),
rw AS (SELECT query_id, src, dst, max(w) AS w FROM (SELECT query_id, src, dst, w FROM first JOIN rel ON name = src UNION ALL SELECT query_id, src, dst, w FROM first JOIN rel ON name = dst UNION ALL SELECT * FROM tied) GROUP BY 1, 2, 3),
rl AS (SELECT query_id, src || ' -- ' || dst || ' (' || src || ', ' || dst || ')' AS line, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, mentions DESC, src, dst) AS rank FROM rw JOIN rel USING (src, dst) QUALIFY rank <= 40),
rb AS (SELECT query_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS t FROM (SELECT *, sum({_WORDS.format("line")}) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM rl) WHERE so_far <= 60 GROUP BY 1),
pl AS (SELECT query_id, chunk_id, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM by_graph JOIN chunks USING (chunk_id) QUALIFY rank <= 8),
pb AS (SELECT query_id, count(*) AS n, string_agg('[Chunk ' || rank || ' - ID: ' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t, arg_min(text, rank) AS best FROM
  (SELECT *, sum({_WORDS.format("text")}) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM pl) WHERE so_far <= 300 GROUP BY 1),
al AS (SELECT item_id AS query_id, b.text, coalesce(eb.n, 0) AS n_entities, coalesce(rb.n, 0) AS n_relations, coalesce(pb.n, 0) AS n_passages, coalesce(eb.t, '') AS e, coalesce(rb.t, '') AS r, coalesce(pb.t, '') AS p, best
  FROM benchmark b LEFT JOIN eb ON eb.query_id = item_id LEFT JOIN rb ON rb.query_id = item_id LEFT JOIN pb ON pb.query_id = item_id)
SELECT query_id, n_entities, n_relations, n_passages, md5(e) AS entities, md5(r) AS relations, CASE WHEN n_entities + n_relations + n_passages > 0 THEN md5({_prompt_sql(answers._ANSWER, "e", "r", "p", "text")}) END AS prompt,
  CASE WHEN n_entities + n_relations + n_passages = 0 THEN {_quoted(prompts.NO_CONTEXT)} ELSE trim(coalesce(best, ''), ' ') END AS answer FROM al"""
#: Words of a text in small letters, and how many hundredths of the first text's the second has.
_SET = "list_distinct(regexp_extract_all(translate({0}, '" + _UPPER + "', lower('" + _UPPER + "')), '[a-z0-9]+'))"
_SHARE = "(CASE WHEN len({0}) = 0 THEN 0 ELSE 100 * len(list_intersect({0}, {1})) // len({0}) END)"
_JUDGED = f"""
fused AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + d.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + s.rank), 0.0)::DOUBLE AS rrf, coalesce(s.rank, -1) AS sr, coalesce(d.rank, -1) AS dr FROM near d FULL JOIN sparse s USING (query_id, chunk_id)),
ordered AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr < 0, dr, sr) AS original_rank, count(*) OVER (PARTITION BY query_id) AS many FROM fused),
met AS (SELECT query_id, chunk_id, original_rank, many, rrf, c.text AS t, b.text AS q, {_SET.format("c.text")} AS ct, {_SET.format("b.text")} AS qt FROM ordered JOIN chunks c USING (chunk_id) JOIN benchmark b ON item_id = query_id),
rated AS (SELECT *, CASE WHEN many = 1 THEN rrf ELSE {_SHARE.format("qt", "ct")} / 10.0 END::DOUBLE AS s FROM met),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, original_rank) AS rank FROM rated QUALIFY rank <= 3),
told AS (SELECT query_id, any_value(q) AS q, any_value(qt) AS qt, string_agg(printf('%s:%.1f:%d', chunk_id, s, original_rank), ' ' ORDER BY rank) AS ranked, trim(arg_min(t, rank), ' ') AS answer,
  {_strip_sql("substr(string_agg(t, chr(10) || chr(10) ORDER BY rank), 1, 3000)")} AS context FROM best GROUP BY 1),
relevance AS (SELECT query_id, avg({_SHARE.format("qt", "ct")} / 100.0) AS c FROM (SELECT query_id, {_SET.format("trim(q, " + _WS + ")")} AS qt, {_SET.format("substr(trim(t, " + _WS + "), 1, 1500)")} AS ct FROM best) GROUP BY 1),
judged AS (SELECT query_id, ranked, answer, c, {_SHARE.format("a", "x")} / 100.0 AS g, {_SHARE.format("qt", "a")} / 100.0 AS r FROM (SELECT *, {_SET.format("answer")} AS a, {_SET.format("context")} AS x FROM told) JOIN relevance USING (query_id))
SELECT item_id AS query_id, coalesce(answer, {_quoted(prompts.NO_CONTEXT)}) AS answer, ranked, round_even(coalesce(c, 0.5)::DOUBLE, 4) AS context_relevance, round_even(coalesce(g, 0.5)::DOUBLE, 4) AS groundedness, round_even(coalesce(r, 0.5)::DOUBLE, 4) AS answer_relevance,
  round_even(((coalesce(c, 0.5) + coalesce(g, 0.5) + coalesce(r, 0.5)) / 3)::DOUBLE, 4) AS composite FROM benchmark LEFT JOIN judged ON item_id = query_id"""
SQL |= {
    "p1_p3_basic_prompts": f"""
WITH {_BM25},
c AS (SELECT query_id, string_agg('[Chunk ' || rank || ' - ID: ' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks FROM sparse JOIN chunks USING (chunk_id) WHERE rank <= 2 AND query_id % 3 <> 0 GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN blocks IS NULL THEN {_quoted(prompts.NO_CONTEXT)} ELSE {_prompt_sql(prompts._ANSWER, "blocks", "text")} END AS prompt FROM benchmark LEFT JOIN c ON item_id = query_id""",
    "c9_chunk_metadata": f"WITH {_CHUNKS} SELECT chunk_id, doc_id::VARCHAR AS source, 'lang' AS extra_keys, d.lang FROM chunks JOIN documents d USING (doc_id)",
    "a7_a10_u1_vector_store": "SELECT vec_id::VARCHAR AS chunk_id, round(CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END * sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings",
    "d11_counts": f"WITH {_CHUNKS} SELECT doc_id::VARCHAR AS source, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY 1",
    "g1_graph_tables": f"""
WITH {_GRAPH}
SELECT name, '' AS other, CASE WHEN contains(name, '-') THEN 'code' ELSE 'word' END AS type, sum(n)::BIGINT AS mentions, count(*) AS n_chunks FROM nodes GROUP BY 1
UNION ALL SELECT src, dst, src || ' ' || dst, sum(n)::BIGINT, count(*) FROM edges GROUP BY 1, 2""",
    "g2_graph_naive": f"WITH {_CHUNKS}, {_NEAREST} SELECT * FROM near",
    "g3_g4_graph_nearest": f"WITH {_GRAPH}, {_QUESTION}, {_NEAR_GRAPH} {_BEST.format('by_graph')}",
    "g3_g4_graph_keywords": f"WITH {_GRAPH}, {_LEVELS}, {_NEAR_GRAPH} {_BEST.format('by_graph')}",
    "g6_graph_answers": f"WITH {_GRAPH}, {_LEVELS}, {_NEAR_GRAPH}, {_GRAPH_ANSWERS}",
    "g3_graph_local": f"WITH {_GRAPH} {_BEST.format('near')}",
    "g4_graph_global": f"WITH {_GRAPH} {_BEST.format('wide')}",
    "g1_g5_graph_hybrid": f"WITH {_GRAPH} {_BEST.format('mixed')}",
    "q1_q2_basic_answers": f"""
WITH {_CHUNKS}, {_NEAREST}
SELECT item_id AS query_id, coalesce(ids, '') AS chunk_ids, coalesce(trim(t, ' '), {_quoted(prompts.NO_CONTEXT)}) AS answer FROM benchmark LEFT JOIN
  (SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS ids, arg_min(text, rank) AS t FROM near JOIN chunks USING (chunk_id) WHERE rank <= 3 GROUP BY 1) ON item_id = query_id""",
    "q4_r1_e1_judged_answers": f"WITH {_BM25}, {_NEAREST}, {_JUDGED}",
    "q3_q4_hybrid_answers": f"""
WITH {_BM25}, {_NEAREST},
fused AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + d.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + s.rank), 0.0)::DOUBLE AS rrf, coalesce(s.rank, -1) AS sr, coalesce(d.rank, -1) AS dr FROM near d FULL JOIN sparse s USING (query_id, chunk_id)),
ordered AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr < 0, dr, sr) AS rank FROM fused QUALIFY rank <= 3)
SELECT item_id AS query_id, coalesce(ids, '') AS chunk_ids, coalesce(trim(t, ' '), {_quoted(prompts.NO_CONTEXT)}) AS answer, 0.5::DOUBLE AS context_relevance, 0.5::DOUBLE AS groundedness, 0.5::DOUBLE AS answer_relevance, 0.5::DOUBLE AS composite FROM benchmark LEFT JOIN
  (SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS ids, arg_min(text, rank) AS t FROM ordered JOIN chunks USING (chunk_id) GROUP BY 1) ON item_id = query_id""",
}
