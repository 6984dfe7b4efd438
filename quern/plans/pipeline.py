"""Corpus build and retrieval as whole plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import PipelineConfig, RetrievalConfig
from quern.functions.text import checksum, chunk_id, fix_lines, iso8601_taipei, minguo_dates, nfkc, normalize_space, strip, strip_html
from quern.operators.bm25 import FullTextIndex, similarity
from quern.operators.chunk import chunk_documents, chunk_records, recursive_chunks
from quern.operators.dedup import drop_table, keep_first, upsert_table
from quern.operators.prompts import contexts, messages, prompt, scored_contexts
from quern.operators.retrieval import asks_for_information, gated, hybrid_search, top_hits
from quern.operators.vectors import vector_top_k
from quern.providers import Embedder, HashEmbedder, LexicalReranker, Reranker, embedding, with_scores
from quern.session import stored
from quern.sinks import write_json_lines
from quern.sources.files import read_files


def clean(documents: DataFrame) -> DataFrame:
    """Documents (title, url, published_at, html_text, pdf_text, text) cleaned; the first of a new checksum stays."""
    whole = lambda c: fix_lines(minguo_dates(nfkc(c)))
    rows = documents.withColumns({"html_text": whole(strip_html("html_text")), "pdf_text": whole(F.coalesce("pdf_text", F.lit("")))})
    own = F.nullif(F.coalesce("text", F.lit("")), F.lit(""))
    both = strip(F.concat(strip("html_text"), F.lit("\n\n"), strip("pdf_text")))
    rows = rows.withColumn("text", normalize_space(F.coalesce(whole(own), both)))
    rows = rows.withColumns({"published_at": iso8601_taipei("published_at"), "url": strip(F.coalesce("url", F.lit(""))), "title": F.coalesce("title", F.lit(""))})
    rows = rows.withColumn("checksum", checksum(F.col("title"), F.col("url"), F.col("published_at"), F.col("text")))
    order = ["doc_id"] if "doc_id" in rows.columns else ["url", "title"]
    return keep_first(rows, ["checksum"], order)


def vector_rows(chunks: DataFrame, embedder: Embedder, cfg: PipelineConfig) -> DataFrame:
    """Index rows (chunk_id, document, metadata, embedding); chunks without id or text are left out."""
    held = chunks.where(F.col("chunk_id").isNotNull() & (strip(F.coalesce("text", F.lit(""))) != ""))
    names = ["title", "url", "published_at", "checksum", "chunk_index"]
    entries = F.map_concat(
        F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"meta.{n}").cast("string").alias("value")) for n in names)), lambda e: e["value"].isNotNull())),
        F.create_map(F.lit("type"), F.coalesce("type", F.lit("text")), F.lit("doc_id"), F.coalesce("doc_id", F.lit("")), *((F.lit("site_slug"), F.lit(cfg.site_slug)) if cfg.site_slug else ())),
    )
    return held.select("chunk_id", F.col("text").alias("document"), entries.alias("metadata"), embedding(embedder, F.col("text"), cfg.embed_batch, cfg.embed_pause).alias("embedding"))


def text_rows(chunks: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Full-text rows; nulls become empty, blank texts stay."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return chunks.select(*(text(F.col(f"meta.{n}")).alias(n) for n in ("title", "url", "published_at")), text(F.col("text")).alias("text"), text(F.col("doc_id")).alias("doc_id"), text(F.col("chunk_id")).alias("chunk_id"), F.coalesce("type", F.lit("text")).alias("type"), F.lit(cfg.site_slug or "").alias("site_slug"))


def run_pipeline(documents: DataFrame, cfg: PipelineConfig, embedder: Embedder | None = None) -> dict[str, int]:
    """Clean, chunk and index ``documents`` into the tables under ``cfg.out``; chunks of known ids are replaced."""
    spark = documents.sparkSession
    write_json_lines(clean(documents), f"{cfg.out}/clean")
    cleaned = spark.read.schema("doc_id string, title string, url string, published_at string, html_text string, pdf_text string, text string, checksum string").json(f"{cfg.out}/clean")
    write_json_lines(chunk_records(cleaned, cfg.target_chars, cfg.overlap), f"{cfg.out}/chunks")
    chunks = spark.read.schema(chunk_records(cleaned).schema).json(f"{cfg.out}/chunks")
    counts = {"documents": cleaned.count(), "chunks": chunks.count()}
    for name, wanted, rows in (("vectors", cfg.embed, lambda: vector_rows(chunks, embedder or HashEmbedder(), cfg)), ("text", cfg.full_text, lambda: text_rows(chunks, cfg))):
        if not wanted:
            continue
        path = f"{cfg.out}/{name}"
        if cfg.rebuild:
            drop_table(spark, path)
        held = upsert_table(spark, path, rows().withColumn("__n", F.monotonically_increasing_id()), "chunk_id", ["__n"])
        counts[name] = held.count()
        if name == "text":
            # Searches read the postings, not the texts.
            FullTextIndex.build(held).write(f"{cfg.out}/postings")
    return counts


def retrieve(spark: SparkSession, queries: DataFrame, out: str, cfg: RetrievalConfig | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, now: datetime | None = None) -> DataFrame:
    """Ranked hits of every query (query_id, query) that asks for information, from the tables that ``run_pipeline`` wrote."""
    cfg = cfg or RetrievalConfig()
    asked = queries.where(asks_for_information(F.col("query")))
    vectors = spark.read.parquet(f"{out}/vectors")
    embedded = asked.select("query_id", embedding(embedder or HashEmbedder(), F.col("query")).alias("vector"))
    near = vector_top_k(embedded, vectors, cfg.vector_pool, vector_id="chunk_id", metric=cfg.metric)
    vector_hits = near.join(vectors.select("chunk_id", "document", "metadata"), "chunk_id").select("query_id", F.col("chunk_id").alias("id"), F.col("document").alias("doc"), F.col("metadata").alias("meta"), F.col("sim").alias("vec_sim"), F.col("rank").alias("place"))
    text_hits = None
    if cfg.use_text:
        rows = spark.read.parquet(f"{out}/text")
        names = ("title", "url", "published_at", "doc_id")
        meta = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*names))
        met = FullTextIndex.open(spark, f"{out}/postings").search(asked, cfg.text_pool)
        text_hits = met.join(rows.select(F.col("chunk_id").alias("id"), F.col("text").alias("doc"), meta.alias("meta")), "id").select("query_id", "id", "doc", "meta", similarity(F.col("score")).alias("bm25_sim"), F.col("rank").alias("place"))
    return hybrid_search(asked, vector_hits, text_hits, reranker or LexicalReranker(), cfg.top_k, cfg.recent_days, now)


def answers_input(queries: DataFrame, hits: DataFrame, least: float = 0.2) -> DataFrame:
    """(query_id, query, messages) for a chat model; a query whose hits are too weak has an empty context."""
    return queries.join(contexts(gated(hits, least)), "query_id", "left").select("query_id", "query", messages(F.col("query"), F.col("context")).alias("messages"))


def inspect(vectors: DataFrame) -> DataFrame:
    """A look at an index: id, metadata, the text's beginning, the first five numbers and the length of each vector."""
    return vectors.select("chunk_id", "metadata", F.substring("document", 1, 100).alias("preview"), F.slice("embedding", 1, 5).alias("first"), F.size("embedding").alias("dims"))


def text_context(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, context): documents chunked, repeated chunks dropped, searched by BM25, and the best chunks of each query."""
    # Chunks are cut once and kept; the index bears their ids as bytes, which sort as the hexadecimal ones do.
    chunks = stored(keep_first(chunk_documents(documents.select("doc_id", "title", "url", "text")), ["chunk_id"], ["doc_id", "chunk_index"]), "chunks")
    found = FullTextIndex.build(chunks.select(F.unhex("chunk_id").alias("chunk_id"), F.col("chunk_text").alias("text")), fields=("text",)).search(queries, k)
    meta = F.map_from_arrays(F.array(F.lit("title"), F.lit("url")), F.array(F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))
    return contexts(found.join(chunks.select(F.unhex("chunk_id").alias("id"), F.col("chunk_text").alias("doc"), meta.alias("meta")), "id"))


def ingest(spark: SparkSession, paths: list[str], out: str, size: int = 1000, overlap: int = 100, reset: bool = False, append: bool = False, embedder: Embedder | None = None) -> int:
    """Files of any readable type as chunks in the vector table ``out``; the number of its rows.

    A chunk's id is that of its file and text, so a file that comes again replaces its chunks; with ``append`` rows are
    added whether known or not. Files that cannot be read are left out; ``read_files`` tells why.
    """
    pieces = read_files(spark, *paths).where(F.col("text").isNotNull()).select("source", F.posexplode(recursive_chunks(size, overlap)("text")).alias("n", "document"))
    rows = pieces.select(chunk_id(F.col("source"), F.col("document")).alias("chunk_id"), "document", F.create_map(F.lit("source"), F.col("source")).alias("metadata"), embedding(embedder or HashEmbedder(), F.col("document")).alias("embedding"), F.col("n").alias("__n"))
    if reset:
        drop_table(spark, out)
    if append:
        rows.write.mode("append").parquet(out)
        return spark.read.parquet(out).count()
    return upsert_table(spark, out, rows, "chunk_id", ["__n"]).count()


def assistant_prompts(queries: DataFrame, vectors: DataFrame, histories: DataFrame | None = None, pool: int = 5, top: int = 3, embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, prompt): the best ``top`` of the ``pool`` nearest chunks of each query with their scores, and its history.

    queries: query_id, query; histories: query_id, history. A query without hits has an empty context.
    """
    embedded = queries.select("query_id", embedding(embedder or HashEmbedder(), F.col("query")).alias("vector"))
    near = vector_top_k(embedded, vectors, pool, vector_id="chunk_id").join(vectors.select("chunk_id", F.col("document").alias("doc")), "chunk_id").withColumnRenamed("rank", "place")
    scored = with_scores(near.join(queries, "query_id"), reranker or LexicalReranker(), "query", "doc", "rr_score")
    asked = queries.join(scored_contexts(top_hits(scored, top)), "query_id", "left")
    asked = asked.join(histories, "query_id", "left") if histories is not None else asked.withColumn("history", F.lit(""))
    return asked.select("query_id", prompt(F.col("query"), F.col("context"), F.col("history")).alias("prompt"))
