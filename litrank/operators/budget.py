"""Response budget (R5) and a skew-safe rank within groups.

The reference cuts every article list of one item type to its first quarter
until the JSON fits 2.5 MiB. Round r therefore keeps the first floor(n / 4^r)
articles of an item with n articles (nested floors equal one floor). An
article at rank i survives up to round ``r_max`` = the largest r with
i * 4^r <= n. The smallest round whose kept bytes fit the budget is found
from per-(group, r_max) byte sums: no loop over rounds, no collected list.

The rank of an article inside its item comes from ``rank_in_groups``, which
range-partitions the rows so one hot item is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litrank.constants import (BUDGET_BYTES, KEY_F, KEY_HIT_PUBS, KEY_ITEM_PUBS, KEY_PRECISION, KEY_RECALL,
                               KEY_SCORE, KEY_SENTIMENT)
from litrank.functions.json_size import escaped_bytes, float_length, int_length, string_length
from litrank.operators.joins import join_bounded
from litrank.session import materialize

# Between two entries of a JSON list or object.
SEPARATOR = len(", ")
# The metrics of an item's JSON and the columns they come from.
METRICS = {KEY_HIT_PUBS: ("n_hit_item", int_length), KEY_ITEM_PUBS: ("n_item", int_length),
           KEY_PRECISION: ("precision", float_length), KEY_RECALL: ("recall", float_length),
           KEY_F: ("f_0_5", float_length), KEY_SENTIMENT: ("sentiment", float_length),
           KEY_SCORE: ("ranking_score", float_length)}
_POS_BITS = 33


def rank_in_groups(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   num_partitions: int | None = None, rank_col: str = "rank",
                   size_col: str | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)``, skew-safe.

    A plain window puts each group in one task. Here rows are range-partitioned
    on (group, order), so a hot group spans several partitions; the row's
    position inside its partition, the start of its group's run there and the
    sizes of the group's runs in earlier partitions give the exact rank. The
    sorted frame is checkpointed so every branch sees the same positions.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    s = (df.repartitionByRange(n, *[F.col(c) for c in keys])
           .sortWithinPartitions(*keys)
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s)
    s = (s.withColumn("_part", F.shiftright("_mid", _POS_BITS))
          .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    runs = s.groupBy("_part", *group_cols).agg(F.min("_pos").alias("_start"),
                                               F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    if size_col:
        runs = runs.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    # One row per (partition, group): about #groups + #partitions rows. Stored
    # once, so its size check is cheap and the rows are never reshuffled for it.
    runs = materialize(runs.drop("_cnt"))
    out = join_bounded(s, runs, ["_part", *group_cols], check=True)
    return (out.withColumn(rank_col, F.col("_pos") - F.col("_start") + F.col("_before") + F.lit(1))
               .drop("_mid", "_part", "_pos", "_start", "_before"))


def article_bytes(cols=("pmid", "title", "db_name", "url", "has_pdf", "pdf_url")):
    """Bytes of one article's JSON object, as Python's ``json.dumps`` writes it."""
    js = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    return escaped_bytes(js) + F.lit(2 * len(cols) - 1)


def shell_bytes(columns: Sequence[str]):
    """Bytes of one item's JSON entry with an empty article list, and the separator before the
    next one: name, counter and metrics. What ``columns`` lacks is not part of the entry."""
    size = string_length(F.coalesce("name", "item_id")) + F.lit(len(": {") + len('"item_pmids": []') + len("}") + SEPARATOR)
    if "n_hit_item" in columns:
        size = size + int_length("n_hit_item") + F.lit(len('"counter": ') + SEPARATOR)
    held = {k: v for k, v in METRICS.items() if v[0] in columns}
    if held:
        size = size + F.lit(len('"metrics": {}') + SEPARATOR + SEPARATOR * (len(held) - 1))
        for key, (column, length) in held.items():
            size = size + length(column) + F.lit(len(f'"{key}": '))
    return size.cast("bigint")


def _r_max(rank_col: str, n_col: str):
    """Largest r >= 0 with rank * 4^r <= n, corrected to be exact (products of
    integers below 2^53 are exact in doubles)."""
    i = F.col(rank_col).cast("double")
    n = F.col(n_col).cast("double")
    guess = F.greatest(F.floor(F.log(4.0, n / i)), F.lit(0)).cast("int")

    def fits_round(r):
        return i * F.pow(F.lit(4.0), r.cast("double")) <= n

    up = F.when(fits_round(guess + 1), guess + 1).otherwise(guess)
    return F.when(~fits_round(up), up - 1).otherwise(up)


def trim_to_budget(articles: DataFrame, items: DataFrame,
                   group_cols: Sequence[str] = ("query_id", "item_type"),
                   budget_bytes: int = BUDGET_BYTES,
                   num_partitions: int | None = None, with_rounds: bool = False):
    """Keep the article rows that survive the budget rounds.

    ``articles`` has group cols, item_id, pmid and the article fields (J4);
    ``items`` has group cols, item_id, name, counter and metric columns (the
    returned items); a group's size is exactly that of its JSON. Adds
    ``rank`` (position in the item's pmid-sorted list), ``trim_round`` (the
    round taken) and ``over_budget`` (true when even empty lists exceed the
    budget; the reference would loop forever there). With ``with_rounds`` also
    returns (group cols, trim_round, over_budget) for every group, those whose
    lists come out empty included.
    """
    g = list(group_cols)
    item_key = [*g, "item_id"]
    sized = articles.withColumn("_bytes", article_bytes())
    ranked = rank_in_groups(sized, item_key, ["pmid"], num_partitions, "rank", size_col="_n")
    # each article but the first of a list follows a separator
    ranked = ranked.withColumn("_rmax", _r_max("rank", "_n")) \
        .withColumn("_bytes", F.col("_bytes") + F.when(F.col("rank") > 1, SEPARATOR).otherwise(0))

    per_round = ranked.groupBy(*g, "_rmax").agg(F.sum("_bytes").alias("_b"))
    shell = items.groupBy(*g).agg(F.sum(shell_bytes(items.columns)).alias("_shell"))
    w_desc = Window.partitionBy(*g).orderBy(F.desc("_rmax"))
    cum = per_round.withColumn("_at_least", F.sum("_b").over(w_desc.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.join(shell, g, "left").withColumn("_shell", F.coalesce("_shell", F.lit(0)))
    # candidate rounds: 0 keeps everything; v+1 drops the articles whose r_max is v
    cand = cum.select(*g, F.lit(0).alias("_r"),
                      (F.col("_shell") + F.max("_at_least").over(Window.partitionBy(*g))).alias("_total"))
    cand = cand.unionByName(cum.select(*g, (F.col("_rmax") + 1).alias("_r"),
                                       (F.col("_shell") + F.col("_at_least") - F.col("_b")).alias("_total")))
    choice = cand.groupBy(*g).agg(
        F.min(F.when(F.col("_total") <= budget_bytes, F.col("_r"))).alias("_fit"),
        F.max("_r").alias("_last"))
    choice = choice.select(*g, F.coalesce("_fit", "_last").alias("trim_round"),
                           F.col("_fit").isNull().alias("over_budget"))
    # one row per group: stored, counted, broadcast - a group's rows never meet in one task
    choice = materialize(choice)
    out = join_bounded(ranked, choice, g, check=True)
    kept = out.where(F.col("_rmax") >= F.col("trim_round")).drop("_bytes", "_n", "_rmax")
    return (kept, choice) if with_rounds else kept
