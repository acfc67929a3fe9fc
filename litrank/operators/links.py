"""Joins over the link table.

The link table (pmid, [db_name,] item_id, item_type) is the fact table; it can
hold duplicates (the reference's key is not a key). Joins against other large
tables shuffle on ``pmid``; catalogs and counters are lookups whose size is
checked before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.functions.text import normalize_query
from litrank.functions.urls import article_url, has_pdf, pdf_url
from litrank.operators.joins import (DEFAULT_MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES, ROWS_IN_TASK, join_bounded,
                                     join_stored, measured, tasks_for)

ITEM_KEY = ["item_id", "item_type"]


# Q of a query batch is broadcast to the link scan up to this many (query, pmid) rows.
MAX_BROADCAST_HITS = 1_000_000


def restrict_links(links: DataFrame, hits: DataFrame, distinct_hits: bool = False,
                   max_broadcast_hits: int = MAX_BROADCAST_HITS, rows_in_task: int = ROWS_IN_TASK) -> DataFrame:
    """Links of the articles in Q, per query -> (query_id, pmid, item_id, item_type, ...).

    ``hits`` is (query_id, pmid); pass ``distinct_hits=True`` when it may hold
    repeats (Q is a set). A single query without ``query_id`` is a semi join.
    Q is usually far smaller than the link table: when its row count is within
    ``max_broadcast_hits`` it is broadcast and the link table is never
    shuffled; beyond it a shuffle join on pmid over as many tasks as the rows
    need (Spark's runtime Bloom filter from Q prunes the link scan). Q alone is
    given that number: Spark moves links to the same tasks, and leaves links
    stored bucketed by pmid where they are, with Q in their buckets.
    """
    h = hits.select("query_id", "pmid") if "query_id" in hits.columns else hits.select("pmid")
    if distinct_hits:
        h = h.distinct()
    how = "left_semi" if "query_id" not in h.columns else "inner"
    rows, size, articles = measured(h, F.approx_count_distinct("pmid"))
    if rows <= max_broadcast_hits and size <= MAX_BROADCAST_BYTES and max_broadcast_hits > 0:
        return links.join(F.broadcast(h), ["pmid"], how)
    # a link becomes one row for each query that has its article
    times = max(1.0, rows / max(1, articles)) if how == "inner" else 1.0
    # of a number below the session's Spark would make its own
    least = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks_for(rows + links.count() * times, least, rows_in_task)
    return links.join(h.repartition(tasks, "pmid").hint("merge"), ["pmid"], how)


def item_catalog(drugs: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(item_id, name, item_type) from filtered drug and target catalogs."""
    parts = []
    if drugs is not None:
        parts.append(drugs.select("item_id", "name", F.lit("drug").alias("item_type")))
    if targets is not None:
        parts.append(targets.select("item_id", "name", F.lit("target").alias("item_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_names(items: DataFrame, catalog: DataFrame,
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Item id -> name. Items missing from the catalog are dropped."""
    cat = catalog.select(*ITEM_KEY, "name")
    return join_bounded(items, cat, ITEM_KEY, "inner", max_rows)


def attach_totals(items: DataFrame, counters: DataFrame,
                  max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, check: bool = False) -> DataFrame:
    """Item -> total article count (``n_item``) from the counter table.

    Counters are keyed by item_id alone, as the reference's counter table is.
    The counter table is usually an aggregate, so AQE decides the strategy
    from its measured size (``check=True`` counts it first).
    """
    tot = counters.select("item_id", F.col("counter").alias("n_item"))
    return join_bounded(items, tot, ["item_id"], "inner", max_rows, check=check)


def attach_article_info(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Left join article metadata by ``pmid``.

    Adds title, db_name, url (P7), has_pdf, pdf_url (P8). An article without
    metadata gets "", "", "", false, "". A matched row keeps a null title.
    """
    meta = titles.select("pmid", F.col("db_name").alias("_db"), F.col("url").alias("_url"),
                         F.col("title").alias("_title"), F.col("pmcid").alias("_pmcid"),
                         F.lit(True).alias("_matched"))
    base = rows.drop("title", "db_name", "url", "has_pdf", "pdf_url")
    j = base.join(meta, "pmid", "left")
    m = F.coalesce(F.col("_matched"), F.lit(False))
    return (j.withColumn("title", F.when(m, F.col("_title")).otherwise(F.lit("")))
             .withColumn("db_name", F.when(m, F.col("_db")).otherwise(F.lit("")))
             .withColumn("url", F.when(m, article_url("_db", "pmid", "_url")).otherwise(F.lit("")))
             .withColumn("has_pdf", F.when(m, has_pdf("_pmcid")).otherwise(F.lit(False)))
             .withColumn("pdf_url", F.when(m, pdf_url("_pmcid")).otherwise(F.lit("")))
             .drop("_db", "_url", "_title", "_pmcid", "_matched"))


def attach_sentiment(rows: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Left join each article row to its sentiment score (null if unscored)."""
    return rows.join(sentiments.select("pmid", "sentiment_score"), "pmid", "left")


def items_to_collect(items: DataFrame, links: DataFrame, useless: DataFrame | None = None,
                     db_name: str = "") -> DataFrame:
    """Catalog items not yet linked in this source and not known to be empty."""
    known = links
    if db_name:
        known = known.where(F.col("db_name") == db_name)
    out = items.join(known.select("item_id").distinct(), "item_id", "left_anti")
    if useless is not None:
        u = useless
        if db_name and "db_name" in u.columns:
            u = u.where(F.col("db_name") == db_name)
        out = out.join(u.select("item_id").distinct(), "item_id", "left_anti")
    return out


def articles_missing_info(links: DataFrame, titles: DataFrame, db_name: str = "",
                          null_aware: bool = False, distinct: bool = False) -> DataFrame:
    """Link rows whose pmid has no metadata; duplicates kept. Titles beyond the
    broadcast bound meet the links in as many tasks as the rows of both need.

    ``null_aware=True`` reproduces SQL ``NOT IN``: one null id in ``titles``
    makes the result empty. ``distinct=True`` gives the fetch list.
    """
    lk = links if not db_name else links.where(F.col("db_name") == db_name)
    if null_aware:
        spark = links.sparkSession
        out = spark.sql("SELECT pmid FROM {lk} WHERE pmid NOT IN (SELECT pmid FROM {t})",
                        lk=lk, t=titles.select("pmid"))
    else:
        out = join_stored(lk.select("pmid"), titles.select("pmid"), ["pmid"], "left_anti", MAX_BROADCAST_HITS)
    return out.distinct() if distinct else out


def query_bucket(col, buckets: int):
    """Hash bucket of a normalised query: the partition column of a stored popular-query cache."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def lookup_popular(queries: DataFrame, cache: DataFrame, buckets: int | None = None):
    """Cached hit lists by normalised query.

    ``cache`` is the long-form popular-query table (query, pmid); a query
    cached without hits has one row with a null pmid. Returns ``(hits,
    misses)``: (query_id, pmid) for cached queries, and the queries that still
    need a live match. Nothing is gathered per query: it is one join.

    A cache stored by ``write_popular`` has its bucket column ``qb``: pass its number of
    ``buckets``, and the broadcast queries prune the scan to their own buckets.
    """
    q = queries.withColumn("_nq", normalize_query("query"))
    c, on = cache.withColumnRenamed("query", "_nq"), ["_nq"]
    if buckets:
        # Spark prunes partitions only by a side that has a selective looking filter
        q, on = q.withColumn("qb", query_bucket("_nq", buckets)).where("qb >= 0"), ["qb", "_nq"]
    c = c.select(*on, "pmid")
    met = join_bounded(c, q.select("query_id", *on), on)
    hits = met.where(F.col("pmid").isNotNull()).select("query_id", "pmid").distinct()
    misses = q.join(met.select("query_id").distinct(), "query_id", "left_anti").select(queries.columns)
    return hits, misses


def orphan_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Links whose item is not in the catalog (the reference fails on them)."""
    return links.join(catalog.select(*ITEM_KEY), ITEM_KEY, "left_anti")
