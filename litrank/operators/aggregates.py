"""Aggregations (A1-A8) and the item metric table (M6).

Every aggregate here is algebraic or a bounded collection, so Spark combines
partial results map-side before the shuffle: a hot item with a third of all
links becomes one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.constants import PRECISION_QUANTILE, RECALL_QUANTILE
from litrank.functions import metrics as M
from litrank.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, broadcastable, join_bounded
from litrank.operators.links import MAX_BROADCAST_HITS, attach_totals
from litrank.operators.quantile import group_quantiles
from litrank.operators.sentiment import exact_mean

QKEY = ["query_id", "item_type", "item_id"]


def item_counters(links: DataFrame) -> DataFrame:
    """A1: non-null pmid count per item over the whole link table.

    The reference groups by item_id only and reads item_type as a bare
    column; ``min`` picks it deterministically.
    """
    return links.groupBy("item_id").agg(F.min("item_type").alias("item_type"),
                                        F.count("pmid").alias("counter"))


def items_in_query(links_q: DataFrame) -> DataFrame:
    """A2: TP = non-null pmid count per (query, item) inside Q."""
    return links_q.groupBy(*QKEY).agg(F.count("pmid").alias("n_hit_item"))


def article_struct(cols=("pmid", "title", "db_name", "url", "has_pdf", "pdf_url")):
    return F.struct(*[F.col(c) for c in cols])


def collect_articles(rows: DataFrame, key=QKEY,
                     cols=("pmid", "title", "db_name", "url", "has_pdf", "pdf_url")) -> DataFrame:
    """A3: the article list of each item, sorted by pmid, duplicates kept.

    Call it on rows already cut by the response budget (R5) so that a list is
    bounded; the budget is what makes a hot item's list fit in one row.
    """
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(article_struct(cols))).alias("articles"))


def per_article(links_q: DataFrame, key=QKEY) -> DataFrame:
    """Distinct (query, item, article) with the number of link rows.

    Grouped right after the pmid-partitioned join, so Spark reuses that
    partitioning and adds no shuffle.
    """
    return links_q.groupBy(*key, "pmid").agg(F.count("pmid").alias("n_links"))


def mean_sentiment(links_q: DataFrame, sentiments: DataFrame, key=QKEY) -> DataFrame:
    """A4: mean score over the item's distinct scored articles in Q; 0.0 if none.

    Summed exactly (``exact_mean``), so the value does not depend on the order
    in which partitions are combined."""
    arts = per_article(links_q, key)
    scored = arts.join(sentiments.select("pmid", "sentiment_score"), "pmid", "left")
    return scored.groupBy(*key).agg(
        F.coalesce(exact_mean("sentiment_score"), F.lit(0.0)).alias("sentiment"))


def tp_and_sentiment(links_q: DataFrame, sentiments: DataFrame, key=QKEY,
                     q_pmids: DataFrame | None = None) -> DataFrame:
    """A2 and A4 in one pass: (key, n_hit_item, sentiment).

    links_q -> distinct articles (no shuffle, same pmid partitioning) -> left
    join sentiments on pmid -> one aggregation per item. ``q_pmids`` (the ids
    of Q) first cuts the article-level score table to Q with a size-checked
    broadcast semi join in its scan, so the whole table is not shuffled. Q
    beyond the bound cuts nothing: the left join moves the scores once, to the
    tasks that hold the links of their articles.
    """
    arts = per_article(links_q, key)
    sc = sentiments.select("pmid", "sentiment_score")
    if q_pmids is not None and broadcastable(q_pmids.select("pmid"), MAX_BROADCAST_HITS):
        sc = sc.join(F.broadcast(q_pmids.select("pmid")), "pmid", "left_semi")
    scored = arts.join(sc, "pmid", "left")
    return scored.groupBy(*key).agg(
        F.sum("n_links").alias("n_hit_item"),
        F.coalesce(exact_mean("sentiment_score"), F.lit(0.0)).alias("sentiment"))


def query_size(hits: DataFrame, distinct: bool = False) -> DataFrame:
    """A5: |Q| per query, ids without links included."""
    if distinct:
        return hits.groupBy("query_id").agg(F.countDistinct("pmid").alias("n_query"))
    return hits.groupBy("query_id").agg(F.count("pmid").alias("n_query"))


def precision_p90(metrics: DataFrame, with_recall: bool = False) -> DataFrame:
    """Exact 0.90 quantile (linear interpolation) of precision per
    (query, item type); optionally the recall quantile the reference computes
    and never uses. ``metrics`` is read twice; pass a stored table."""
    wanted = {"p90": ("precision", PRECISION_QUANTILE)}
    if with_recall:
        wanted["r90"] = ("recall", RECALL_QUANTILE)
    return group_quantiles(metrics, ["query_id", "item_type"], wanted)


def known_items(links: DataFrame, db_name: str = "") -> DataFrame:
    """Distinct item ids, optionally of one source."""
    lk = links if not db_name else links.where(F.col("db_name") == db_name)
    return lk.select("item_id").distinct()


def unique_articles(links: DataFrame, db_name: str = "") -> DataFrame:
    """Distinct article ids, optionally of one source."""
    lk = links if not db_name else links.where(F.col("db_name") == db_name)
    return lk.select("pmid").distinct()


def item_metrics(per_item: DataFrame, counters: DataFrame, qsize: DataFrame,
                 safe_division: bool = False,
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """M6: M1-M5 for every (query, item).

    ``per_item`` has (query_id, item_type, item_id, n_hit_item, sentiment);
    ``counters`` is A1's table; ``qsize`` is A5's. Items without a counter are
    dropped (the reference fails on them).
    """
    x = attach_totals(per_item, counters, max_rows, check=False)
    x = join_bounded(x, qsize, ["query_id"], "inner", max_rows, check=False)
    p = M.precision("n_hit_item", "n_item", safe_division)
    r = M.recall("n_hit_item", "n_query", safe_division)
    x = x.withColumn("precision", p).withColumn("recall", r)
    x = x.withColumn("f_0_5", M.f_beta("precision", "recall", safe=safe_division))
    return x.withColumn("ranking_score", M.ranking_score("f_0_5", "sentiment"))
