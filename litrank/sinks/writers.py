"""Sinks (K1-K7).

Tables are Parquet directories. There is no in-place update: an upsert builds
the new version as a DataFrame and writes it to a new path, which then becomes
the current one (H5). One ``upsert`` serves the three insert-or-replace call
sites (titles, sentiments, popular queries).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.functions.text import normalize_query
from litrank.operators.joins import join_bounded
from litrank.operators.links import query_bucket
from litrank.session import materialize


def write_hits(df: DataFrame, path: str) -> str:
    """K1: export matching articles as JSON lines (a directory)."""
    df.write.mode("overwrite").json(path)
    return path


def upsert(base: DataFrame | None, new: DataFrame, keys: Sequence[str],
           order_col: str | None = None) -> DataFrame:
    """Insert-or-replace: a new row replaces the base row of its key; inside
    the new batch the row with the largest ``order_col`` wins (the last one).

    One aggregation with ``max_by``: map-side partial aggregation keeps a key
    that holds a third of all rows from reaching one task whole. Ties on the
    order are broken by the row content, so a retried task picks the same row.
    """
    keys = list(keys)
    cols = [c for c in new.columns if c not in (order_col,)]
    vals = [c for c in cols if c not in keys]
    seq = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    n = new.select(*cols, F.lit(1).alias("_src"), seq.alias("_seq"))
    parts = n
    if base is not None:
        b = base.select(*cols, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("_seq"))
        parts = b.unionByName(n)
    rec = F.struct(*[F.col(c) for c in vals])
    order = F.struct("_src", "_seq", F.xxhash64(*[F.col(c) for c in vals]).alias("_h"))
    out = parts.groupBy(*keys).agg(F.max_by(rec, order).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in vals])


def upsert_titles(base: DataFrame | None, new: DataFrame, order_col: str | None = None) -> DataFrame:
    """K2: article metadata by pmid; null ids are not stored."""
    return upsert(base, new.where(F.col("pmid").isNotNull()), ["pmid"], order_col)


def upsert_sentiments(base: DataFrame | None, new: DataFrame, order_col: str | None = None) -> DataFrame:
    """K5: sentiment score by pmid."""
    return upsert(base, new.where(F.col("pmid").isNotNull()), ["pmid"], order_col)


def upsert_popular_queries(base: DataFrame | None, new: DataFrame) -> DataFrame:
    """K6: replace the whole hit list of a (normalised) query.

    Long form (query, pmid): the new rows of a query replace all its old rows.
    Keys are normalised with T1, as the reference stores them.
    """
    n = new.select(normalize_query("query").alias("query"), "pmid").distinct()
    if base is None:
        return n
    # rows that stay are distinct already, and of other queries than the new ones
    return base.join(n.select("query").distinct(), "query", "left_anti").unionByName(n)


def append_links(base: DataFrame | None, new: DataFrame, mode: str = "append") -> DataFrame:
    """K3: add links. ``append`` keeps duplicates (the reference's key is not a
    key, D1); ``distinct`` adds only links not present yet."""
    cols = ["pmid", "db_name", "item_id", "item_type"]
    n = new.select(*cols)
    if base is None:
        return n if mode == "append" else n.distinct()
    b = base.select(*cols)
    if mode == "append":
        return b.unionByName(n)
    if mode == "distinct":
        # Which new links exist already: the (usually small) new batch is
        # broadcast into a semi join over the base scan, so the base table is
        # read but never shuffled; then the batch minus those.
        nd = materialize(n.distinct())       # measured, joined and subtracted
        seen = join_bounded(b, nd, cols, "left_semi").distinct()
        fresh = nd.join(seen, cols, "left_anti")
        return b.unionByName(fresh)
    raise ValueError(f"unknown mode {mode!r}")


def replace_counters(counters: DataFrame, path: str) -> str:
    """K4: a new version of the item counter table, in a new folder below ``path``; returns that
    folder. The old version stays readable until the caller drops it."""
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex[:12]}"
    counters.write.mode("errorifexists").parquet(version)
    return version


def append_dump(df: DataFrame, path: str, dump_date: str) -> str:
    """K7: append (abstract, title, doi) as a date-stamped JSON-lines dump."""
    (df.select("abstract", "title", "doi").withColumn("dump_date", F.lit(dump_date))
       .write.mode("append").partitionBy("dump_date").json(path))
    return path


def write_table(df: DataFrame, path: str, sort_within: Sequence[str] | None = None,
                cluster_by: str | Sequence[str] | None = None, partitions: int | None = None) -> str:
    """Write a table version to a new path (never in place).

    ``cluster_by`` range-partitions the rows (e.g. links by pmid, item_id), so
    Parquet min/max statistics let a later id filter skip row groups - the role
    the reference's index plays. A second column lets the range boundaries
    split one very frequent first-column value over several files.
    """
    out = df
    if cluster_by:
        cols = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by)
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(n, *cols)
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    out.write.mode("errorifexists").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, key: str = "pmid", buckets: int = 512,
                   path: str | None = None) -> str:
    """Store a pmid-keyed table (links, titles, sentiments) bucketed and sorted
    by ``key``. Tables written with the same key and bucket count join on it
    without shuffling either side; a query batch's Q is the only side that
    moves. ``path`` puts the files in a shared folder (an external table)."""
    w = df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return table


def write_popular(cache: DataFrame, path: str, buckets: int) -> str:
    """Store the popular-query cache (query, pmid) partitioned by a hash bucket ``qb`` of the query.
    The rows of a bucket are spread by pmid, so that no hit list is written by one task alone."""
    spread = F.pmod(F.xxhash64("pmid"), F.lit(16))
    (cache.select("query", "pmid", query_bucket("query", buckets).alias("qb"))
     .repartition(F.col("qb"), spread).write.mode("errorifexists").partitionBy("qb").parquet(path))
    return path
