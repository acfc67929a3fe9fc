"""Exact quantiles of groups of any size.

``percentile`` holds all distinct values of a group in one task. That is done
where no group has more than ``MOST_IN_TASK`` rows, which is measured. Else the
rows become one count per distinct value, by an aggregation that combines in the map
tasks; the counts are range-partitioned by (group, value), so that a hot group
spans many partitions. The counts of a group's runs, one per partition, say in
which partitions its two order statistics lie, and only those runs are summed
up value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litrank.operators.joins import join_bounded
from litrank.session import materialize


# Rows of a group whose distinct values one task may hold.
MOST_IN_TASK = 1_000_000


def group_quantiles(df: DataFrame, group_cols: Sequence[str], wanted: dict[str, tuple[str, float]],
                    most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(*group, one column per wanted name): the quantiles ``{name: (value column, quantile)}`` of
    each group. ``df`` is read several times; pass a stored table."""
    g = list(group_cols)
    most = df.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    if most <= most_in_task:
        return df.groupBy(*g).agg(*[F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()])
    parts = [spread_quantile(df, g, c, q, name) for name, (c, q) in wanted.items()]
    out = parts[0]
    for part in parts[1:]:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in g]
        out = out.alias("a").join(part.alias("b"), same).select("a.*", *[f"b.{c}" for c in part.columns if c not in g])
    return out


def spread_quantile(df: DataFrame, group_cols: Sequence[str], value_col: str, quantile: float,
                    name: str, num_partitions: int | None = None) -> DataFrame:
    """(*group, name): the quantile of ``value_col`` in each group, interpolated linearly between
    the two nearest values as ``percentile`` does. Nulls do not count; a group with no other
    value has a null quantile."""
    g = list(group_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(*g, F.col(value_col).cast("double").alias("_v")).groupBy(*g, "_v") \
        .agg(F.when(F.col("_v").isNotNull(), F.count(F.lit(1))).otherwise(0).alias("_n"))
    counts = materialize(counts.repartitionByRange(n, *g, "_v").withColumn("_part", F.spark_partition_id()))
    runs = counts.groupBy(*g, "_part").agg(F.sum("_n").alias("_n"))
    in_order = Window.partitionBy(*g).orderBy("_part")
    runs = runs.withColumn("_end", F.sum("_n").over(in_order)) \
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*g))) \
        .withColumn("_at", (F.col("_all") - 1) * F.lit(float(quantile))) \
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")

    def holds(place):
        return (F.col("_begin") <= place) & (place < F.col("_end"))

    # at most two runs of a group, and one row for a group without values
    picked = materialize(runs.where(holds(low) | holds(high) | (F.col("_all") == 0))
                         .select(*g, "_part", "_begin", "_at"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*g, "_part"]]
    rows = join_bounded(counts.alias("c"), picked.alias("p"), same).select(
        *[F.col(f"c.{c}").alias(c) for c in g], "c._part", "_v", "_n", "_begin", "_at")
    summed = Window.partitionBy(*g, "_part").orderBy("_v")
    rows = rows.withColumn("_end", F.col("_begin") + F.sum("_n").over(summed)) \
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    found = rows.groupBy(*g).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_low"),
                                 F.max(F.when(holds(high), F.col("_v"))).alias("_high"),
                                 F.max("_at").alias("_at"))
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")) \
        .otherwise((high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high"))
    return found.select(*g, value.alias(name))
