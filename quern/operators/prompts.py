"""Ranked hits and histories as prompts, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import score_text, strip

RULES = "你是校務問答助理，以繁體中文作答。只依據所附來源；引用處以編號標示，例如 [1]。來源沒有答案時，直接說明並指出可查的連結。"
NO_TITLE = "(無標題)"


def ordered_text(group: list[str], df: DataFrame, text: Column, order: list[str | Column], separator: str, out: str) -> DataFrame:
    """One text a group: the parts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["__text"]), separator).alias(out))


def context_block(rank: Column, meta: Column, doc: Column) -> Column:
    """``[rank] title | time``, the link and the passage; a missing title has a stand-in, a null or empty one has none."""
    get = lambda k, default="": F.coalesce(F.when(F.map_contains_key(meta, k), F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("None"))), F.lit(default))
    return F.format_string("[%d] %s | %s\n%s\n%s\n", rank, get("title", NO_TITLE), get("published_at"), get("url"), strip(F.coalesce(doc, F.lit(""))))


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context) of ranked hits (query_id, rank, meta, doc)."""
    return ordered_text(["query_id"], hits, context_block(F.col("rank"), F.col("meta"), F.col("doc")), ["rank"], "\n", "context")


def scored_contexts(hits: DataFrame, score: str = "rr_score") -> DataFrame:
    """(query_id, context): passages with their scores, parted by rules."""
    return ordered_text(["query_id"], hits, F.concat(F.lit("(score "), score_text(F.col(score)), F.lit(")\n"), F.col("doc")), ["rank"], "\n\n---\n\n", "context")


def messages(query: Column, context: Column, rules: str = RULES) -> Column:
    """A system and a user message."""
    asked = F.concat(F.lit("問題："), query, F.lit("\n\n=== 來源 ===\n"), F.coalesce(context, F.lit("")), F.lit("\n=== 來源完 ===\n"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), asked.alias("content")))


def histories(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", last: int | None = None) -> DataFrame:
    """(conversation, history): ``role: content`` a line in the order of the turns; the ``last`` turns only, if given."""
    line = F.concat(F.col(role), F.lit(": "), F.col(content))
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("at"), line.alias("line"))))
    kept = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (last or 0) + 1), F.lit(last)) if last else parts
    return turns.groupBy(conversation).agg(F.array_join(F.transform(kept, lambda p: p["line"]), "\n").alias("history"))


def prompt(query: Column, context: Column, history: Column, rules: str = RULES) -> Column:
    """Rules, memory, passages and question as one text."""
    return F.concat(F.lit(f"[系統]\n{rules}\n\n[記憶]\n"), F.coalesce(history, F.lit("")), F.lit("\n\n[段落]\n"), F.coalesce(context, F.lit("")), F.lit("\n\n[使用者]\n"), query)
