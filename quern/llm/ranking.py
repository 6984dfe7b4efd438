"""One ranking out of several scores on different scales: closeness to the ideal point.

Within a query each score is winsorised at two of its quantiles, shifted to its lower one and divided by its vector
norm. A hit's weighted distances to the best and the worst value of every score give its closeness, worst / (best +
worst). A score that a hit lacks takes no part in its distances, which are means over the scores that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of more rows are ranked in so many steps of closeness, each in a task of its own.
HOT_ROWS, STEPS = 50_000, 4096
#: ``percentile_approx`` is exact up to so many items a query; beyond, quantiles are counted in so many steps of values.
ACCURACY, CUTS = 10_000, 256


def _usable(score: str, zero_is_missing: bool) -> Column:
    c = F.col(f"`{score}`").cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok & (c != 0.0) if zero_is_missing else ok, c)


def _counted_bounds(items: DataFrame, names: list[str], quantiles: tuple[float, float]) -> DataFrame:
    """(q, an array of the two quantiles ``<name>_e`` for each of ``names``), exact: the values below each step are counted, and one step sorted."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("s"), F.col(n).alias("v")) for i, n in enumerate(names)))).alias("e")
    counts = items.select("q", each).select("q", "e.*").where(F.col("v").isNotNull()).groupBy("q", "s", "v").agg(F.count(F.lit(1)).alias("times"))
    # Any cuts give the right values; even ones keep the steps small.
    cuts = counts.groupBy("q", "s").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], ACCURACY).alias("cuts"), F.sum("times").alias("total"))
    stepped = counts.join(cuts.select("q", "s", "cuts"), ["q", "s"]).select("q", "s", "v", "times", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("step"))
    sums = stepped.groupBy("q", "s", "step").agg(F.sum("times").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("q", "s").orderBy("step"))
    place = lambda x: F.greatest(F.lit(1), F.col("total") - F.floor(F.col("total") - F.col("total") * F.lit(x)))
    wanted = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), place(x).alias("place")) for j, x in enumerate(quantiles)))).alias("w")
    places = sums.withColumn("upto", upto).join(cuts.select("q", "s", "total"), ["q", "s"]).select("q", "s", "step", "held", "upto", wanted).where((F.col("w.place") <= F.col("upto")) & (F.col("w.place") > F.col("upto") - F.col("held")))
    near = stepped.join(places.select("q", "s", "step", F.col("w.j").alias("j"), (F.col("w.place") - F.col("upto") + F.col("held")).alias("rest")), ["q", "s", "step"])
    met = near.withColumn("met", F.sum("times").over(Window.partitionBy("q", "s", "j").orderBy("v"))).where("met >= rest").groupBy("q", "s", "j").agg(F.min("v").alias("v"))
    pick = lambda i, j: F.max(F.when((F.col("s") == i) & (F.col("j") == j), F.col("v")))
    return met.groupBy("q").agg(*(F.array(pick(i, 0), pick(i, 1)).alias(f"{n}_e") for i, n in enumerate(names)))


def ideal_point_ranking(hits: DataFrame, scores: dict[str, float], query: str = "query_id", row: str = "hit_id", item: str = "id", quantiles: tuple[float, float] = (0.1, 0.9), zero_is_missing: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``query``, ``row``, ``item``, closeness, rank) for every hit.

    scores: column -> weight. Null, NaN and infinite scores are missing, and 0.0 too unless ``zero_is_missing`` is false.
    rank counts the items of a query from 1, by closeness rounded to 9 digits and then by the smallest ``row``; the same
    item twice in a query is one item with its best scores, and both its hits bear its rank. A hit without an item is an
    item of its own. Closeness is 0.5 where no score tells the query's items apart and 0 for items without any score.
    The quantiles are elements of the scores and exact; those of queries of more than 10,000 items are counted in steps of
    values. Queries of more than ``hot_rows`` items are ranked in parallel steps of closeness. A null query is a query of its own.
    """
    low, high = quantiles
    total = sum(scores.values())
    names = {s: f"s{i}" for i, s in enumerate(scores)}
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{item}`").cast("string")), F.concat(F.lit("#"), F.col(f"`{row}`").cast("string")), F.lit("#"))
    rows = hits.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{query}`").cast("string")), F.lit("")).alias("q"), key.alias("k"), F.col(f"`{query}`").alias("query"), F.col(f"`{row}`").alias("row"), F.col(f"`{item}`").alias("item"), *(_usable(s, zero_is_missing).alias(n) for s, n in names.items()))
    items = rows.groupBy("q", "k").agg(F.min("row").alias("first"), *(F.max(n).alias(n) for n in names.values()))
    bounds = items.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(n, [low, high], ACCURACY).alias(f"{n}_b") for n in names.values()))
    counted = _counted_bounds(items.join(bounds.where(F.col("n") > ACCURACY).select("q"), "q"), list(names.values()), quantiles)
    bounds = bounds.join(counted, "q", "left").select("q", "n", *(F.coalesce(f"{n}_e", f"{n}_b").alias(f"{n}_b") for n in names.values()))
    clipped = items.join(bounds, "q").withColumns({n: F.least(F.greatest(F.col(n), F.get(f"{n}_b", F.lit(0))), F.get(f"{n}_b", F.lit(1))) - F.get(f"{n}_b", F.lit(0)) for n in names.values()} | {f"{n}_has": F.col(n).isNotNull() for n in names.values()})
    # least and greatest skip nulls, so what was missing is told apart by its flag.
    clipped = clipped.select("q", "k", "first", "n", *(F.when(F.col(f"{n}_has"), F.col(n)).alias(n) for n in names.values()))
    norms = clipped.groupBy("q").agg(*(x for n in names.values() for x in (F.sqrt(F.sum(F.col(n) * F.col(n))).alias(f"{n}_norm"), F.max(n).alias(f"{n}_max"), F.min(n).alias(f"{n}_min"))))
    scored = clipped.join(norms, "q")
    best, worst, has = F.lit(0.0), F.lit(0.0), F.lit(0)
    for s, n in names.items():
        unit = F.when(F.col(n).isNotNull(), F.lit(scores[s] / total) / F.when(F.col(f"{n}_norm") > 0, F.col(f"{n}_norm")).otherwise(1.0))
        square = lambda x: F.coalesce(x * x, F.lit(0.0))
        best += square((F.col(f"{n}_max") - F.col(n)) * unit)
        worst += square((F.col(n) - F.col(f"{n}_min")) * unit)
        has += F.col(n).isNotNull().cast("int")
    to_best, to_worst = F.sqrt(best / has), F.sqrt(worst / has)
    closeness = F.when(has == 0, 0.0).when(best + worst == 0, 0.5).otherwise(F.round(to_worst / (to_best + to_worst), 9))
    closed = scored.select("q", "k", "first", closeness.alias("closeness"), F.when(F.col("n") > hot_rows, F.floor((1 - closeness) * STEPS)).otherwise(F.lit(0)).alias("step"))
    before = closed.groupBy("q", "step").count().select("q", "step", (F.sum("count").over(Window.partitionBy("q").orderBy("step")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("q", "step").orderBy(F.desc("closeness"), "first"))
    ranked = closed.withColumn("within", within).join(before, ["q", "step"]).select("q", "k", "closeness", (F.col("within") + F.col("before")).alias("rank"))
    return rows.join(ranked, ["q", "k"]).select(F.col("query").alias(query), F.col("row").alias(row), F.col("item").alias(item), "closeness", "rank")
