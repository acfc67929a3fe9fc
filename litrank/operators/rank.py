"""Ranking: overrides (R1), percentile filter (R2), top-k (R3), the per-query
filter switch (R4) and the display order (R6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litrank.constants import (OVERRIDE_NAMES, OVERRIDE_SCORE, OVERRIDE_TRIGGERS,
                               PRECISION_QUANTILE, TOP_K)
from litrank.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_bounded
from litrank.operators.quantile import group_quantiles

GROUP = ["query_id", "item_type"]


def default_rules(spark) -> DataFrame:
    """The reference's single override rule as a rule table
    (trigger, item_name, score): every trigger x every name."""
    rows = [(t, n, OVERRIDE_SCORE) for t in OVERRIDE_TRIGGERS for n in OVERRIDE_NAMES]
    return spark.createDataFrame(rows, "trigger string, item_name string, score double")


def apply_overrides(items: DataFrame, queries: DataFrame, rules: DataFrame | None = None,
                    item_type: str = "drug",
                    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Set ranking_score to the rule's score when the lowered query contains
    the rule's trigger and the item's name is the rule's name; drugs only.

    Items meet the rules of their name only, and of the rules that apply the
    largest score is kept by a maximum per (query, item), so that no list of a
    name's rules is built.
    """
    if rules is None:
        rules = default_rules(items.sparkSession)
    lowered = rules.select(F.col("item_name").alias("name"), F.lower("trigger").alias("_t"), F.col("score").alias("_s")) \
        .distinct()
    named = items.where(F.col("item_type") == item_type).select("query_id", "item_id", "name")
    lq = queries.select("query_id", F.lower("query").alias("_lq"))
    met = join_bounded(join_bounded(named, lowered, ["name"], "inner", max_rows), lq, ["query_id"], "inner", max_rows)
    best = met.where(F.col("_lq").contains(F.col("_t"))).groupBy("query_id", "item_id").agg(F.max("_s").alias("_best")) \
        .withColumn("item_type", F.lit(item_type))
    x = join_bounded(items, best, ["query_id", "item_type", "item_id"], "left", max_rows, check=False)
    return x.withColumn("ranking_score", F.coalesce("_best", "ranking_score")).select(*items.columns)


def with_p90(metrics: DataFrame, quantile: float = PRECISION_QUANTILE) -> DataFrame:
    """Attach the exact precision quantile of each (query, item type): one row per group, joined
    by AQE's measured broadcast or a shuffle. ``metrics`` is read several times; pass a stored table."""
    p90 = group_quantiles(metrics, GROUP, {"p90": ("precision", quantile)})
    return join_bounded(metrics, p90, GROUP, check=False)


def filter_above_p90(metrics: DataFrame, do_filter_col: str | None = None) -> DataFrame:
    """R2 (+R4): keep precision strictly above the group's 0.90 quantile.

    A group of one item, or of equal precisions, comes out empty. Rows whose
    query has ``do_filter`` false pass unchanged, with a null ``p90``.
    """
    if do_filter_col is None:
        return with_p90(metrics).where(F.col("precision") > F.col("p90"))
    kept = filter_above_p90(metrics.where(F.col(do_filter_col)))
    passed = metrics.where(~F.col(do_filter_col)).withColumn("p90", F.lit(None).cast("double"))
    return kept.select(passed.columns).unionByName(passed)


def top_k_by_score(items: DataFrame, k: int = TOP_K, do_filter_col: str | None = None) -> DataFrame:
    """R3 (+R4): the k largest ranking scores per (query, item type); ties by
    item_id ascending. Rows of a query with ``do_filter`` false are all kept, with a null ``rank``.

    The filter on the rank stands alone behind its window, so that Spark keeps only k rows of a
    group in each map task (its group limit) before the shuffle.
    """
    if do_filter_col is None:
        w = Window.partitionBy(*GROUP).orderBy(F.desc_nulls_last("ranking_score"), F.asc("item_id"))
        return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    passed = items.where(~F.col(do_filter_col)).withColumn("rank", F.lit(None).cast("int"))
    return top_k_by_score(items.where(F.col(do_filter_col)), k).unionByName(passed)


def rank_items(metrics: DataFrame, k: int = TOP_K, do_filter_col: str | None = None) -> DataFrame:
    """R2 -> R3 for the queries that filter; R4: the others pass by both. ``metrics`` is read
    several times; pass a stored table."""
    if do_filter_col is None:
        return top_k_by_score(filter_above_p90(metrics), k)
    passed = metrics.where(~F.col(do_filter_col)).withColumns(
        {"p90": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
    kept = rank_items(metrics.where(F.col(do_filter_col)), k)
    return kept.select(passed.columns).unionByName(passed)


def sort_for_display(items: DataFrame) -> DataFrame:
    """The drugs of each query by F-0.5 descending (item_id breaks ties), with their position."""
    w = Window.partitionBy("query_id").orderBy(F.desc("f_0_5"), F.asc("item_id"))
    drugs = items.where(F.col("item_type") == "drug")
    return drugs.withColumn("position", F.row_number().over(w)).orderBy("query_id", "position")
