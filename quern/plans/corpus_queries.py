"""Queries over whole tables for the corpus and retrieval operators, each with its SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.records import flatten_json
from quern.operators import chunk, prompts, retrieval
from quern.operators.bm25 import FullTextIndex, tokens
from quern.operators.dedup import existing_checksums, imported_identity, keep_first, unseen, upsert
from quern.operators.vectors import l2_norm, vector_top_k
from quern.plans import pipeline
from quern.plans.naturalize import with_sentence
from quern.session import new_path, table
from quern.streaming.ingest import append_unseen

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: White space of Unicode as a class of RE2.
_SP = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- scalars


@query("SELECT rec_no, sha256(concat(coalesce(title, ''), coalesce(url, ''), coalesce(published_at, ''), coalesce(text, ''))) AS checksum FROM clean_latest_news")
def document_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_latest_news").select("rec_no", tx.checksum(F.col("title"), F.col("url"), F.col("published_at"), F.col("text")).alias("checksum"))


@query("SELECT rec_no, sha1(coalesce(text, '')) AS sha FROM course_table_row")
def row_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "course_table_row").select("rec_no", tx.sha1_of(F.col("text")).alias("sha"))


_SEMESTER = "CASE WHEN {0} IN (" + ", ".join(f"'{k}'" for k in tx.SEMESTERS) + ") THEN '大' || {0} || '學期' ELSE {0} END"


@query(f"SELECT rec_no, {_SEMESTER.format('s')} AS semester_name FROM (SELECT rec_no, {_strip('''coalesce(semester, '')''')} AS s FROM course_table_row)")
def semester_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "course_table_row").select("rec_no", tx.semester_name(F.col("semester")).alias("semester_name"))


_PARTS = {c: f"nullif({_strip(f'coalesce({c}, {chr(39)}{chr(39)})')}, '')" for c in ("title", "semester", "category", "sub_category", "course_name")}


@query(
    f"""
    WITH p AS (SELECT rec_no, type, {", ".join(f"{e} AS {c}" for c, e in _PARTS.items())}, credit FROM course_table_row),
    s AS (SELECT rec_no, type, regexp_replace(concat_ws('，', title, '在' || {_SEMESTER.format("semester")}, '屬於' || category, sub_category || '類',
        '課程名稱為「' || course_name || '」', '學分數為 ' || credit::VARCHAR || ' 學分'), '^，+|，+$', '', 'g') AS t FROM p)
    SELECT rec_no, CASE WHEN type NOT IN ('course_table_row', 'table_row') THEN '' WHEN t = '' OR ends_with(t, '。') THEN t ELSE t || '。' END AS sentence FROM s
    """
)
def record_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sentence(table(spark, sf_dir, "course_table_row").drop("published_at").withColumn("published_at", F.lit(None).cast("string")))[0].select("rec_no", "sentence")


@query(
    f"""
    SELECT rec_no, array_to_string(list_filter([semester, category, sub_category, course_name, credit::VARCHAR || ' 學分'], lambda x: {_strip("coalesce(x, '')")} <> ''), '｜') AS row_text,
           regexp_replace(concat(coalesce(semester, ''), '｜', coalesce(category, ''), '｜', coalesce(sub_category, '')), '^｜+|｜+$', '', 'g') AS edges_cut
    FROM course_table_row
    """
)
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = F.concat(F.col("credit").cast("string"), F.lit(" 學分"))
    return table(spark, sf_dir, "course_table_row").select("rec_no", tx.joined([*(F.col(c) for c in ("semester", "category", "sub_category", "course_name")), credit]).alias("row_text"), tx.joined_all([F.col(c) for c in ("semester", "category", "sub_category")]).alias("edges_cut"))


@query(f"SELECT rec_no, coalesce(nullif(regexp_extract(coalesce(text, ''), '{tx.EMAIL}'), ''), coalesce(text, '')) AS email FROM department_member_row")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "department_member_row").select("rec_no", tx.email_of(F.col("text")).alias("email"))


_SPACED = _strip(r"regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_SPACED} AS clean FROM documents")
def normalized_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_space(F.col("text")).alias("clean"))


_ROC = rf"(1\p{{Nd}}{{2}}){_SP}*年{_SP}*(\p{{Nd}}{{1,2}}){_SP}*月{_SP}*(\p{{Nd}}{{1,2}}){_SP}*日"
_Y, _M, _D = (f"translate(regexp_extract(m, '{_ROC}', {i}), '０１２３４５６７８９', '0123456789')" for i in (1, 2, 3))
_ISO = f"(1911 + {_Y}::INT)::VARCHAR || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0')"


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN list_reduce(regexp_extract_all(text, '{_ROC}'), lambda t, m: replace(t, m, {_ISO}), text) END AS dated FROM documents")
def minguo_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.minguo_dates(F.col("text")).alias("dated"))


@query(rf"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SP}*(?:{tx.BULLET}){_SP}*', '- ')), chr(10)) AS listed FROM documents".replace(r"\-", "-").replace("．-–—", "．–—-").replace(r"\d", r"\p{Nd}"))
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), tx.normalize_bullet), "\n").alias("listed"))


@query("SELECT doc_id, replace(text, chr(10), ' ')[1:100] AS snippet, format('{:.3f}', n_chars / 7.0) AS shown FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.score_text(F.col("n_chars") / 7.0).alias("shown"))


@query(f"SELECT item_id, q <> '' AND lower(q) NOT IN ({', '.join(repr(w) for w in retrieval.SMALL_TALK)}) AS asks FROM (SELECT item_id, {_strip('text')} AS q FROM eval_items)")
def asking_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", retrieval.asks_for_information(F.col("text")).alias("asks"))


@query("SELECT event_id, k AS path, (props::JSON ->> k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def flattened_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(flatten_json("props")).alias("p")).select("event_id", "p.path", "p.value")


@query()
def cleaned_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "clean_latest_news").select("doc_id", "title", "url", "published_at", "text", F.col("source_html_text").alias("html_text"), F.col("source_pdf_text").alias("pdf_text"))
    return pipeline.clean(news)


# ---- chunks

_SENT = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '([。！？!?；;])', '\\1' || chr(10), 'g'), '<S>', chr(10), 'g'), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.sentences(F.col("text"))).alias("pos", "sentence"))


def _chunk_sql(target: int, overlap: int) -> str:
    step = target - overlap
    slices = f"list_transform(range(0, greatest(0, ceil((length(el.b) - {target}) / {step}.0)::BIGINT) + 1), lambda i: {_strip(f'substring(el.b, (i * {step} + 1)::BIGINT, {target})')})"
    flush = f"CASE WHEN {_strip('acc.b')} = '' THEN acc.o ELSE list_append(acc.o, {_strip('acc.b')}) END"
    fold = f"""CASE WHEN length(el.b) > {target} THEN {{'b': '', 'o': list_concat({flush}, {slices})}}
        WHEN acc.b = '' THEN {{'b': el.b, 'o': acc.o}}
        WHEN length(acc.b) + 1 + length(el.b) <= {target} THEN {{'b': acc.b || chr(10) || el.b, 'o': acc.o}}
        ELSE {{'b': right({_strip("acc.b")}, {overlap}) || chr(10) || el.b, 'o': list_append(acc.o, {_strip("acc.b")})}} END"""
    return f"""
    WITH said AS (SELECT doc_id, {_SENT} AS sents FROM documents),
    folded AS (SELECT doc_id, list_reduce(list_transform(sents, lambda x: {{'b': x, 'o': []::VARCHAR[]}}), lambda acc, el: {fold}, {{'b': '', 'o': []::VARCHAR[]}}) AS acc FROM said),
    cut AS (SELECT doc_id, {flush} AS c FROM folded)
    SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS chunk_text FROM cut WHERE len(c) > 0
    UNION ALL SELECT doc_id, 0, '' FROM cut WHERE len(c) = 0"""


@query(_chunk_sql(1000, 150))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "chunk_text")


@query(f"SELECT doc_id, chunk_index, sha1(doc_id::VARCHAR || chr(10) || {_strip(f'regexp_replace(chunk_text, {chr(39)}{_SP}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}) AS chunk_id FROM ({_chunk_sql(200, 40)})")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, sf_dir, "documents"), 200, 40).select("doc_id", "chunk_index", "chunk_id")


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.recursive_chunks(300, 50)("text")).alias("pos", "piece"))


# ---- identity and distinct


@query("SELECT rec_no, CASE WHEN doc_id <> '' AND coalesce(nullif(checksum, ''), NULL) IS NOT NULL THEN checksum ELSE sha256(concat(coalesce(title, ''), coalesce(url, ''), coalesce(published_at, ''), coalesce(text, ''))) END AS checksum, doc_id FROM clean_latest_news")
def imported_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported_identity(table(spark, sf_dir, "clean_latest_news").withColumn("checksum_clean", F.lit(None).cast("string"))).select("rec_no", "checksum", "doc_id")


@query("SELECT min(doc_id) AS doc_id, checksum FROM documents GROUP BY checksum")
def first_of_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "documents").select("doc_id", "checksum"), ["checksum"], ["doc_id"])


_COURSE_KEY = ["doc_id", "semester", "course_name", "credit", "category", "sub_category"]


@query(f"SELECT min(rec_no) AS rec_no, {', '.join(_COURSE_KEY)} FROM course_table_row GROUP BY ALL")
def first_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "course_table_row").select("rec_no", *_COURSE_KEY), _COURSE_KEY, ["rec_no"])


@query("SELECT DISTINCT coalesce(nullif(checksum_clean, ''), sha1(coalesce(text, ''))) AS checksum_clean FROM course_table_row WHERE batch_no = 0")
def known_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return existing_checksums(table(spark, sf_dir, "course_table_row").where("batch_no = 0"))


_UNSEEN = "SELECT min(rec_no) AS rec_no, checksum_clean FROM course_table_row WHERE batch_no > 0 AND checksum_clean NOT IN (SELECT checksum_clean FROM course_table_row WHERE batch_no = 0) GROUP BY checksum_clean"


@query(_UNSEEN)
def unseen_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "course_table_row").select("rec_no", "batch_no", "checksum_clean")
    return unseen(rows.where("batch_no > 0").drop("batch_no"), rows.where("batch_no = 0"), "checksum_clean", ["rec_no"])


@query("SELECT min(rec_no) AS rec_no, checksum_clean FROM course_table_row GROUP BY checksum_clean")
def streamed_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema("rec_no long, checksum_clean string").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/course_table_row.parquet*")
    out, checkpoint = new_path(spark, "streamed"), new_path(spark, "checkpoint")
    append_unseen(rows, out, "checksum_clean", ["rec_no"], checkpoint).awaitTermination()
    return spark.read.parquet(out).select("rec_no", "checksum_clean")


@query(
    """
    WITH last AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rec_no DESC) AS n FROM department_member_row WHERE batch_no > 0)
    SELECT rec_no, doc_id, text FROM last WHERE n = 1
    UNION ALL SELECT rec_no, doc_id, text FROM department_member_row WHERE batch_no = 0 AND doc_id NOT IN (SELECT doc_id FROM last)
    """
)
def upserted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "department_member_row").select("rec_no", "batch_no", "doc_id", "text")
    return upsert(rows.where("batch_no = 0").drop("batch_no"), rows.where("batch_no > 0").drop("batch_no"), "doc_id", ["rec_no"])


# ---- retrieval

_SIDES = """
    v AS (SELECT query_id, id, doc, vec_sim, hit_id AS place FROM search_hits WHERE vec_sim IS NOT NULL),
    b AS (SELECT query_id, id, doc, bm25_sim, hit_id AS place FROM search_hits WHERE bm25_sim IS NOT NULL)"""
_MERGED = f"""{_SIDES},
    u AS (SELECT query_id, id, doc, vec_sim, NULL AS bm25_sim, 0 AS side, place FROM v UNION ALL SELECT query_id, id, doc, NULL, bm25_sim, 1, place FROM b),
    m AS (SELECT query_id, id, arg_min(doc, (side, place)) AS doc, greatest(coalesce(max(vec_sim), 0), 0) AS vec_sim,
                 greatest(coalesce(max(bm25_sim), 0), 0) AS bm25_sim, min((side, place)) AS place FROM u GROUP BY query_id, id)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").withColumn("place", F.col("hit_id"))
    return retrieval.merge_hits(hits.where("vec_sim IS NOT NULL"), hits.where("bm25_sim IS NOT NULL"))


@query(f"WITH {_MERGED} SELECT query_id, id, doc, vec_sim, bm25_sim FROM m")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("query_id", "id", "doc", "vec_sim", "bm25_sim")


@query(
    f"""
    WITH {_MERGED}, d AS (SELECT *, doc AS document FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY 0.6 * vec_sim + 0.4 * bm25_sim DESC, place) AS n FROM d)
    SELECT query_id, document, id FROM r WHERE n = 1
    """
)
def best_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _merged(spark, sf_dir).withColumn("meta", F.map_concat("meta", F.create_map(F.lit("doc_id"), F.col("doc"))))
    return retrieval.best_per_document(named).select("query_id", "document", "id")


@query("SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY rr_score DESC NULLS LAST, hit_id) AS rank FROM search_hits QUALIFY rank <= 5")
def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_hits(table(spark, sf_dir, "search_hits").withColumn("place", F.col("hit_id")), 5).select("query_id", "hit_id", "rank")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr_score DESC NULLS LAST, hit_id) AS rank FROM search_hits QUALIFY rank <= 5) SELECT query_id, hit_id FROM t QUALIFY max(rr_score) OVER (PARTITION BY query_id) >= 2.0")
def gated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.top_hits(table(spark, sf_dir, "search_hits").withColumn("place", F.col("hit_id")), 5)
    return retrieval.gated(top, 2.0).select("query_id", "hit_id")


_ZONED = r"regexp_matches(coalesce(fetched_at, ''), '^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$')"


@query(rf"SELECT rec_no FROM department_member_row WHERE CASE WHEN {_ZONED} THEN coalesce(try_cast(fetched_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2022-06-02 00:00:00+00', true) ELSE true END")
def recent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "department_member_row")
    return rows.where(retrieval.recent(F.col("fetched_at"), 30, datetime(2022, 7, 2, tzinfo=UTC))).select("rec_no")


@query(
    f"""
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr_score DESC NULLS LAST, hit_id) AS rank FROM search_hits QUALIFY rank <= 5)
    SELECT query_id, string_agg('[' || rank || '] (無標題) | ' || chr(10) || chr(10) || {_strip("coalesce(doc, '')")} || chr(10), chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id
    """
)
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.contexts(retrieval.top_hits(table(spark, sf_dir, "search_hits").withColumn("place", F.col("hit_id")), 5))


@query(
    """
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr_score DESC NULLS LAST, hit_id) AS rank FROM search_hits QUALIFY rank <= 3)
    SELECT query_id, string_agg('(score ' || coalesce(format('{:.3f}', rr_score), 'NA') || ')' || chr(10) || doc, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id
    """
)
def scored_context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.scored_contexts(retrieval.top_hits(table(spark, sf_dir, "search_hits").withColumn("place", F.col("hit_id")), 3))


@query("SELECT user_id, string_agg(event_type || ': ' || props, chr(10) ORDER BY event_id) AS history FROM events GROUP BY user_id")
def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.histories(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "props")


_ASKED = [(1, "visa letter"), (2, "export? (control)"), (3, "thesis"), (4, "museum archives license"), (5, "因"), (6, "分機 1155"), (7, "the"), (8, ""), (9, "gpu the the")]
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_NINE = f"SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in _ASKED)}) AS q(query_id, query)"
#: Every hundredth document asks with its first words.
_WORDS = 4
_EVERY = f"SELECT doc_id AS query_id, array_to_string(list_slice({_TOK.format('text')}, 1, {_WORDS}), ' ') AS query FROM documents WHERE doc_id % 100 = 0"


def _bm25(asked: str) -> str:
    return f"""
    q AS ({asked}),
    w AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents),
    l AS (SELECT doc_id, len(t) AS dl, (SELECT count(*) FROM documents) AS n, avg(len(t)) OVER () AS mean FROM w),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY ALL),
    a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("regexp_replace(query, '[?()]', ' ', 'g')")}) AS term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, doc_id, -sum(CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * times) AS score, count(*) AS met
          FROM p JOIN a USING (term) JOIN f USING (term) JOIN l USING (doc_id) GROUP BY query_id, doc_id),
    r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank FROM s JOIN (SELECT query_id, count(*) AS terms FROM a GROUP BY query_id) USING (query_id) WHERE met = terms)"""


def _first_words(documents: DataFrame) -> DataFrame:
    """(query_id, query): the first words of every document whose id is divisible by 100."""
    return documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 1, _WORDS), " ").alias("query"))


def _documents_found(documents: DataFrame, queries: DataFrame) -> DataFrame:
    found = FullTextIndex.build(documents, "doc_id", ("text",)).search(queries, 50)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(_NINE)} SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rank <= 50")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_found(table(spark, sf_dir, "documents"), spark.createDataFrame(_ASKED, "query_id int, query string"))


@query(f"WITH {_bm25(_EVERY)} SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rank <= 50")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every document whose id is divisible by 100, asked of all documents."""
    documents = table(spark, sf_dir, "documents")
    return _documents_found(documents, _first_words(documents))


@query(
    """
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, list_dot_product(v, embedding::DOUBLE[]) / sqrt(list_dot_product(v, v) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS sim FROM q, embeddings)
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 5
    """
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_top_k(queries, vectors, 5).select("query_id", "vec_id", "rank")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dims FROM chunk_vectors WHERE embedding IS NOT NULL")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_vectors").where("embedding IS NOT NULL").select("vec_id", F.round(l2_norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dims"))


@query("SELECT chunk_id, document[1:100] AS preview, embedding[1:5]::DOUBLE[] AS first, len(embedding) AS dims FROM chunk_vectors WHERE embedding IS NOT NULL")
def index_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pipeline.inspect(table(spark, sf_dir, "chunk_vectors").where("embedding IS NOT NULL"))
    return seen.select("chunk_id", "preview", F.col("first").cast("array<double>").alias("first"), "dims")


@query()
def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from documents to messages for a chat model."""
    from quern.config import PipelineConfig, RetrievalConfig

    out = new_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "title", "url", F.lit(None).cast("string").alias("published_at"), F.lit("").alias("html_text"), F.lit("").alias("pdf_text"), "text")
    pipeline.run_pipeline(docs, PipelineConfig(out))
    queries = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = pipeline.retrieve(spark, queries, out, RetrievalConfig(use_text=True))
    return pipeline.answers_input(queries, hits)


@query()
def text_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, searched by the first words of every hundredth one, and the best chunks of each query as one context."""
    documents = table(spark, sf_dir, "documents")
    return pipeline.text_context(documents, _first_words(documents))
