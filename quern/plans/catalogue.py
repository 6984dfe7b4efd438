"""Further queries over whole tables, each with its SQL: text forms, timetables and cards, prompts, caches and hybrid retrieval."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import members, prompts, retrieval, timetable
from quern.operators.bm25 import FullTextIndex
from quern.operators.vectors import vector_top_k
from quern.plans.corpus_queries import _EVERY, _ROC, _SEMESTER, _bm25, _first_words, _strip, query
from quern.plans.naturalize import with_sentence
from quern.session import new_path, table


@cache
def nfkc_forms() -> str:
    """VALUES of the characters that compatibility composition changes, by rule."""
    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    return ", ".join("('" + c + "', '" + f.replace("'", "''") + "')" for c in chars if (f := unicodedata.normalize("NFKC", c)) != c and unicodedata.normalize("NFC", c) == c)


def _nfkc_sql(strings: str) -> str:
    return f"""
    nfkc_map AS (SELECT * FROM (VALUES {nfkc_forms()}) AS m(c, f)),
    strings AS (SELECT DISTINCT s, nfc_normalize(s) AS t FROM ({strings}) WHERE s IS NOT NULL),
    folded AS (SELECT s, nfc_normalize(string_agg(coalesce(f, c), '' ORDER BY i)) AS form FROM (SELECT s, i, substring(t, i, 1) AS c FROM (SELECT s, t, unnest(generate_series(1, length(t))) AS i FROM strings)) LEFT JOIN nfkc_map USING (c) GROUP BY s)"""


@query(f"WITH {_nfkc_sql('SELECT course_name AS s FROM course_table_row')} SELECT rec_no, coalesce(form, course_name) AS folded FROM course_table_row LEFT JOIN folded ON s = course_name")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "course_table_row").select("rec_no", tx.nfkc(F.col("course_name")).alias("folded"))


@query("SELECT rec_no, strftime(fetched_at::TIMESTAMPTZ AT TIME ZONE 'Asia/Taipei', '%Y-%m-%dT%H:%M:%S') || '+08:00' AS iso FROM department_member_row")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "department_member_row").select("rec_no", tx.iso8601_taipei("fetched_at").alias("iso"))


def _escaped(c: str):
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN '' ELSE title || chr(10) END || 'x' || chr(10) || source AS plain FROM documents")
def stripped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<div><h1>"), _escaped("title"), F.lit("</h1><script>var p = '</p>';</script><!-- y --><style>p {}</style><p>x</p>"), _escaped("source"), F.lit("</div>"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_html(html).alias("plain"))


# ---- cleaning chain: compatibility forms, dates, list marks, spaces, one checksum a document

_B = tx.BULLET.replace(r"\-", "-").replace("．-–—", "．–—-").replace(r"\d", r"\p{Nd}")
_SP1 = _strip("x")[len("regexp_replace(x, '^") : _strip("x").index("]+") + 1]
_Y, _M, _D = (f"translate(regexp_extract(m, '{_ROC}', {i}), '０１２３４５６７８９', '0123456789')" for i in (1, 2, 3))
_ISO = f"(1911 + {_Y}::INT)::VARCHAR || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0')"
_LINE = _strip(f"regexp_replace(regexp_replace(replace(regexp_replace(x, '^{_SP1}*(?:{_B}){_SP1}*', '- '), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(
    f"""
    WITH {_nfkc_sql("SELECT text AS s FROM documents")},
    dated AS (SELECT s, list_reduce(regexp_extract_all(form, '{_ROC}'), lambda t, m: replace(t, m, {_ISO}), form) AS t FROM folded),
    lined AS (SELECT s, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_LINE}), chr(10)) AS t FROM dated)
    SELECT doc_id, {_strip("regexp_replace(coalesce(t, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean FROM documents LEFT JOIN lined ON s = text
    """
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning chain of a document's text: compatibility forms, Minguo dates, lines, spaces."""
    whole = tx.fix_lines(tx.minguo_dates(tx.nfkc(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_space(whole).alias("clean"))


# ---- timetables and cards

_SUB = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{words}') THEN '{sub}'" for sub, words in timetable.SUBJECTS) + " ELSE '' END"


@query(f"SELECT rec_no, sub, CASE WHEN sub <> '' THEN '{timetable.COMMON}' ELSE '{timetable.OWN}' END AS cat FROM (SELECT rec_no, {_SUB.format('''coalesce(course_name, '')''')} AS sub FROM course_table_row)")
def sub_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = timetable.sub_category(F.col("course_name"))
    return table(spark, sf_dir, "course_table_row").select("rec_no", sub.alias("sub"), timetable.category(sub).alias("cat"))


@query(
    """
    WITH t AS (SELECT rec_no, list_filter(regexp_split_to_array(replace(replace(text, ' 學分', '學分'), '｜', ' '), '[\\s\\p{Z}]+'), lambda x: x <> '') AS t FROM course_table_row),
    e AS (SELECT rec_no, t, list_filter(range(1, len(t) + 1), lambda i: regexp_full_match(t[i], '[（(]\\d+[）)]|\\d+學分')) AS ends FROM t)
    SELECT rec_no, k - 1 AS course_no, array_to_string(t[(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1 : ends[k] - 1], ' ') AS raw, regexp_extract(t[ends[k]], '\\d+')::INT AS credit
    FROM (SELECT rec_no, t, ends, unnest(generate_series(1, len(ends))) AS k FROM e)
    """
)
def credit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.array(F.translate(F.replace("text", F.lit(" 學分"), F.lit("學分")), "｜", " "))
    return table(spark, sf_dir, "course_table_row").select("rec_no", F.posexplode(timetable.credit_tokens(block)).alias("course_no", "c")).select("rec_no", "course_no", "c.raw", "c.credit")


@query("SELECT l_orderkey, l_linenumber, (SELECT arg_min(i, (abs((x + x + 3) / 2 - c), i)) FROM (VALUES (0, 12.5), (1, 40.0), (2, 77.0), (3, 99.0)) h(i, c)) AS col FROM (SELECT l_orderkey, l_linenumber, 2 * l_quantity AS x FROM lineitem)")
def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = 2 * F.col("l_quantity")
    word, centres = F.struct(x.alias("x0"), (x + 3).alias("x1")), F.array(*map(F.lit, (12.5, 40.0, 77.0, 99.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timetable.nearest_column(word, centres).alias("col"))


@query(
    f"""
    WITH l AS (SELECT user_id, epoch(ts)::DOUBLE / 100000 AS y, event_type AS t, event_id FROM events),
    s AS (SELECT *, y - lag(y) OVER w AS step FROM l WINDOW w AS (PARTITION BY user_id ORDER BY y, t)),
    g AS (SELECT user_id, least({timetable.GAP_MOST}, greatest({timetable.GAP_LEAST}, {timetable.GAP_MEDIANS} * coalesce(list_sort(list(step) FILTER (step IS NOT NULL))[count(step) // 2 + 1], {timetable.GAP_DEFAULT}))) AS gap FROM s GROUP BY user_id),
    b AS (SELECT user_id, t, y, sum(CASE WHEN step > gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y, t ROWS UNBOUNDED PRECEDING) AS block_no FROM s JOIN g USING (user_id))
    SELECT user_id, block_no::INT AS block_no, string_agg(t, ' ' ORDER BY y, t) AS said FROM b GROUP BY user_id, block_no
    """
)
def gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parted into blocks where the step from one to the next is larger than usual; here the events of a user."""
    lines = table(spark, sf_dir, "events").select("user_id", F.struct((F.unix_timestamp(F.col("ts").cast("timestamp")) / 100000).alias("y"), F.col("event_type").alias("text")).alias("line")).groupBy("user_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select("user_id", F.posexplode(timetable.blocks(F.col("lines"))).alias("block_no", "b")).select("user_id", "block_no", F.array_join("b", " ").alias("said"))


_FACTS = "list_reduce(list_prepend([person_name], list_transform([phone, email, office, metadata], lambda x: [coalesce(x, '')])), lambda k, p: CASE WHEN list_bool_or(list_transform(k, lambda x: contains(x, p[1]))) OR p[1] = '{0}' THEN k ELSE list_concat(k, p) END)".format(members.HEADING)


@query(
    f"""
    WITH f AS (SELECT rec_no, {_FACTS} AS f, contains(person_name, '{members.ADJUNCT}') AS adjunct FROM (SELECT rec_no, {", ".join(f"{_strip(c)} AS {c}" for c in ("person_name", "phone", "email", "office", "metadata"))} FROM department_member_row)),
    p AS (SELECT rec_no, f[1] AS person_name, CASE WHEN adjunct THEN '' ELSE coalesce(f[2], '') END AS phone, coalesce(CASE WHEN adjunct THEN f[5] ELSE f[3] END, '') AS mail,
        CASE WHEN adjunct THEN '' ELSE coalesce(f[4], '') END AS office, CASE WHEN adjunct THEN array_to_string(f[2:4], '。') ELSE array_to_string(f[5:], '') END AS metadata FROM f)
    SELECT rec_no, person_name, phone, coalesce(nullif(regexp_extract(mail, '{tx.EMAIL}'), ''), mail) AS email, office, metadata FROM p
    """
)
def member_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particulars of members, written as cards of a page and read from them by their places."""
    paragraphs = F.concat(*(F.concat(F.lit("<p>"), _escaped(c), F.lit("</p>")) for c in ("phone", "email", "office", "metadata")))
    html = F.concat(F.lit(f'<div class="{members.CARD_CLASS}"><span style="{members.NAME_STYLE}">'), _escaped("person_name"), F.lit("</span>"), paragraphs, F.lit("</div>"))
    rows = table(spark, sf_dir, "department_member_row").select("rec_no", html.alias("html"))
    return members.member_records(rows).select("rec_no", "person_name", "phone", "email", "office", "metadata")


@query("SELECT rec_no, type, course_name, credit FROM course_table_row UNION ALL BY NAME SELECT rec_no, type, person_name FROM department_member_row")
def crawl_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "course_table_row").select("rec_no", "type", "course_name", "credit")
    return courses.unionByName(table(spark, sf_dir, "department_member_row").select("rec_no", "type", "person_name"), allowMissingColumns=True)


# ---- sentences, caches, prompts


@query(f"SELECT rec_no, coalesce(contains(text, {_strip('category')}), true) AND coalesce(nullif({_strip('sub_category')}, '') IS NULL OR contains(text, {_strip('sub_category')}), true) AND contains(text, {_strip('course_name')}) AND coalesce(contains(text, {_strip('semester')}) OR contains(text, {_SEMESTER.format(_strip('semester'))}), true) AND coalesce(contains(text, credit::VARCHAR), true) AS keeps FROM course_table_row")
def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row's text holds every one of its fields."""
    return table(spark, sf_dir, "course_table_row").select("rec_no", tx.sentence_keeps_fields(F.col("text"), *(F.col(c) for c in ("semester", "category", "sub_category", "course_name", "credit"))).alias("keeps"))


@query("WITH c AS (SELECT checksum_clean, arg_max('第 ' || rec_no || ' 列', rec_no) AS said FROM course_table_row WHERE batch_no = 0 GROUP BY checksum_clean) SELECT rec_no, said FROM course_table_row JOIN c USING (checksum_clean)")
def cached_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a cache of the accepted rows holds; the last entry of a key counts."""
    from quern.plans.naturalize import load_cache

    rows = table(spark, sf_dir, "course_table_row")
    cache_ = load_cache(rows.where("batch_no = 0").select(F.col("checksum_clean").alias("key"), F.concat(F.lit("第 "), F.col("rec_no").cast("string"), F.lit(" 列")).alias("text"), F.col("rec_no").alias("seq")))
    said = with_sentence(rows, cache_)[0].select("rec_no", "checksum_clean", F.col("sentence").alias("said"))
    return said.join(cache_.select(F.col("key").alias("checksum_clean")), "checksum_clean", "left_semi").select("rec_no", "said")


@query("WITH t AS (SELECT query_id, string_agg(doc, '|' ORDER BY hit_id) AS c FROM search_hits GROUP BY query_id) SELECT query_id, '問題：' || query_id || chr(10) || chr(10) || '=== 來源 ===' || chr(10) || coalesce(c, '') || chr(10) || '=== 來源完 ===' || chr(10) AS asked, 2 AS parts FROM t")
def built_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = prompts.ordered_text(["query_id"], table(spark, sf_dir, "search_hits").where("doc IS NOT NULL"), F.col("doc"), ["hit_id"], "|", "c")
    every = table(spark, sf_dir, "search_hits").select("query_id").distinct().join(context, "query_id", "left")
    built = every.select("query_id", prompts.messages(F.col("query_id").cast("string"), F.col("c")).alias("m"))
    return built.select("query_id", F.get("m", F.lit(1))["content"].alias("asked"), F.size("m").alias("parts"))


# ---- retrieval


def _vector_sql(sim: str) -> str:
    return f"""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM chunk_vectors WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL),
    s AS (SELECT query_id, vec_id, {sim} AS sim FROM q, e)
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""


def _vector_search(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    vectors = table(spark, sf_dir, "chunk_vectors")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_top_k(queries, vectors, 5, metric=metric).select("query_id", "vec_id", "rank")


@query(_vector_sql("1 - (list_dot_product(v, v) + list_dot_product(e, e) - 2 * list_dot_product(v, e))"))
def vector_search_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_search(spark, sf_dir, "l2sq")


@query(_vector_sql("list_dot_product(v, e)"))
def vector_search_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_search(spark, sf_dir, "dot")


class _Shared:
    """A reranker that counts the characters of the passage up to the query's length; plain enough for SQL."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(len(q) * 1000 - abs(len(d) - 40)) for q, d in pairs]


@query(
    """
    WITH v AS (SELECT query_id, id, doc, vec_sim, NULL::DOUBLE AS bm25_sim, 0 AS side, hit_id AS place FROM search_hits WHERE vec_sim IS NOT NULL AND trim(coalesce(doc, '')) <> ''),
    b AS (SELECT query_id, id, doc, NULL::DOUBLE AS vec_sim, bm25_sim, 1 AS side, hit_id AS place FROM search_hits WHERE bm25_sim IS NOT NULL),
    m AS (SELECT query_id, id, arg_min(doc, (side, place)) AS doc, greatest(coalesce(max(vec_sim), 0), 0) AS vs, greatest(coalesce(max(bm25_sim), 0), 0) AS bs, min((side, place)) AS place
          FROM (SELECT * FROM v UNION ALL SELECT * FROM b) GROUP BY query_id, id),
    d AS (SELECT *, min(place) OVER (PARTITION BY query_id, doc) AS first_place, row_number() OVER (PARTITION BY query_id, doc ORDER BY 0.6 * vs + 0.4 * bs DESC, place) AS n FROM m)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY -abs(length(coalesce(doc, '')) - 40) DESC, first_place) AS rank FROM d WHERE n = 1 QUALIFY rank <= 5
    """
)
def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of two sides, best chunk of a document, rerank and cut, for all queries at once."""
    hits = table(spark, sf_dir, "search_hits").withColumns({"place": F.col("hit_id"), "meta": F.map_concat("meta", F.create_map(F.lit("doc_id"), F.coalesce("doc", F.lit(""))))})
    queries = hits.select("query_id").distinct().select("query_id", F.lit("問").alias("query"))
    return retrieval.hybrid_search(queries, hits.where("vec_sim IS NOT NULL"), hits.where("bm25_sim IS NOT NULL"), _Shared()).select("query_id", "id", "rank")


@query(f"WITH {_bm25(_EVERY)} SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rank <= 50")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search as ``document_search``, over an index that was written once and is only read."""
    documents, path = table(spark, sf_dir, "documents"), new_path(spark, "index")
    FullTextIndex.build(documents, "doc_id", ("text",)).write(path)
    return FullTextIndex.open(spark, path).search(_first_words(documents), 50).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
