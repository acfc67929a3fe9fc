"""Optional-predicate selections.

Id lists are DataFrames joined with ``left_semi`` (broadcast after a row
check, else a shuffle join), never literals spliced into SQL text, so they can
be as large as the data. Python lists are accepted for
small hand-made lists and turned into a one-column DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.constants import DRUG_STATE, DRUG_TYPE
from litrank.operators.joins import join_bounded


def _ids(spark, ids, col: str) -> DataFrame | None:
    if ids is None:
        return None
    if isinstance(ids, DataFrame):
        # no distinct: a semi join ignores repeated keys, and a shuffle is saved
        return ids.select(F.col(ids.columns[0]).cast("string").alias(col))
    ids = list(ids)
    if not ids:
        return None
    return spark.createDataFrame([(str(i),) for i in ids], f"{col} string")


def links_where(links: DataFrame, pmids=None, item_ids=None, item_type: str = "") -> DataFrame:
    """Conjunction of optional id-list and type predicates; empty = no predicate."""
    out = links
    spark = links.sparkSession
    p = _ids(spark, pmids, "pmid")
    if p is not None:
        out = join_bounded(out, p, ["pmid"], "left_semi")
    i = _ids(spark, item_ids, "item_id")
    if i is not None:
        out = join_bounded(out, i, ["item_id"], "left_semi")
    if item_type:
        out = out.where(F.col("item_type") == item_type)
    return out


def titles_where(titles: DataFrame, pmids=None) -> DataFrame:
    """The five metadata columns, optionally for an id list."""
    out = titles.select("pmid", "db_name", "url", "title", "pmcid")
    p = _ids(titles.sparkSession, pmids, "pmid")
    return out if p is None else join_bounded(out, p, ["pmid"], "left_semi")


def sentiments_where(sentiments: DataFrame, pmids=None) -> DataFrame:
    """(pmid, sentiment_score), optionally for an id list."""
    out = sentiments.select("pmid", "sentiment_score")
    p = _ids(sentiments.sparkSession, pmids, "pmid")
    return out if p is None else join_bounded(out, p, ["pmid"], "left_semi")


def split_by_type(links: DataFrame, item_type: str) -> DataFrame:
    """Rows of one item type."""
    return links.where(F.col("item_type") == item_type)


def unusable_drugs(drug_catalog: DataFrame, id_col: str = "drugbank_id") -> DataFrame:
    """Drug ids that fail the catalog filter. A null type or state fails too,
    as pandas ``!=`` is true for a missing value."""
    bad = ~(F.col("type").eqNullSafe(F.lit(DRUG_TYPE))) | ~(F.col("state").eqNullSafe(F.lit(DRUG_STATE)))
    return drug_catalog.where(bad).select(F.col(id_col).cast("string").alias("item_id"))


def drop_unusable_links(links: DataFrame, drug_catalog: DataFrame,
                        id_col: str = "drugbank_id") -> DataFrame:
    """P5: delete links of drugs that are not small-molecule and solid."""
    return links.join(unusable_drugs(drug_catalog, id_col).distinct(), "item_id", "left_anti")


def db_filter(df: DataFrame, db_name: str = "") -> DataFrame:
    """Optional source filter; "" keeps every source."""
    return df if not db_name else df.where(F.col("db_name") == db_name)
