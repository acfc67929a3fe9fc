"""Offline jobs: popular-query cache (B2), corpus sentiment (B3), link and
metadata ingest (B4).

Each returns the new table versions as DataFrames; writing them to fresh paths
is the caller's choice (``litrank.sinks.writers.write_table``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.operators.aggregates import item_counters
from litrank.operators.containment import link_items, match_batch
from litrank.operators.links import articles_missing_info, items_to_collect
from litrank.operators.sentiment import sentiment_lexicon
from litrank.session import materialize
from litrank.sinks.writers import append_links, upsert_popular_queries, upsert_sentiments, upsert_titles
from litrank.sources.readers import dedup_articles


def precompute_popular(queries: DataFrame, corpus: DataFrame, cache: DataFrame | None = None,
                       id_col: str = "doi", fields: Sequence[str] | None = None) -> DataFrame:
    """B2: match a list of frequent queries and store their hit ids (K6).

    The cache is long form (query, pmid): a query's hit list is never gathered
    into one value. A query without hits keeps one row with a null pmid.
    """
    q = queries.select("query_id", "query")
    hits = match_batch(dedup_articles(corpus, key=id_col), q, id_col=id_col, fields=fields)
    rows = q.join(hits.select("query_id", F.col(id_col).cast("string").alias("pmid")),
                  "query_id", "left")
    return upsert_popular_queries(cache, rows.select("query", "pmid"))


def score_corpus(dumps: DataFrame, lexicon: DataFrame, stopwords, base: DataFrame | None = None) -> DataFrame:
    """Dumps -> one row per doi (the last file wins, as repeated
    insert-or-replace over the files leaves it) -> T7 -> T8 -> T9 -> K5."""
    arts = dedup_articles(dumps, key="doi", keep="last")
    scores = sentiment_lexicon(arts, lexicon, stopwords, id_col="doi", text_col="abstract")
    new = scores.select(F.col("doi").alias("pmid"), "sentiment_score")
    return upsert_sentiments(base, new)


@dataclass
class IngestResult:
    links: DataFrame
    titles: DataFrame
    useless: DataFrame
    missing_info: DataFrame
    counters: DataFrame


def ingest(articles: DataFrame, items: DataFrame, links: DataFrame | None, titles: DataFrame | None,
           useless: DataFrame | None, db_name: str, mode: str = "append",
           fields: Sequence[str] | None = None, phrase: bool = False) -> IngestResult:
    """J6 -> J8 -> K3 (+ empty items) -> K2 -> J7 -> A1.

    ``articles`` (doi, title, abstract) is the local corpus of source
    ``db_name``; every pending item is matched in one containment join instead
    of one remote request per item. Matched articles' titles are stored as the
    local source does (url and pmcid unknown).
    """
    todo = items if links is None else items_to_collect(items, links, useless, db_name)
    # stored once: the articles and the new links feed all outputs
    arts = materialize(dedup_articles(articles, key="doi").withColumn("db_name", F.lit(db_name)))
    new_links, _ = link_items(arts, todo, id_col="doi", fields=fields, phrase=phrase)
    new_links = materialize(new_links)
    empty = todo.select("item_id", "item_type").join(
        new_links.select("item_id", "item_type").distinct(), ["item_id", "item_type"], "left_anti")
    all_links = append_links(links, new_links, mode)
    new_useless = empty.select(F.lit(db_name).alias("db_name"), "item_id")
    if useless is not None:
        new_useless = useless.select("db_name", "item_id").unionByName(new_useless).distinct()
    matched = arts.join(new_links.select(F.col("pmid").alias("doi")).distinct(), "doi", "left_semi")
    new_titles = matched.select(F.col("doi").cast("string").alias("pmid"), F.lit(db_name).alias("db_name"),
                                F.lit(None).cast("string").alias("url"), "title",
                                F.lit(None).cast("string").alias("pmcid"))
    all_titles = upsert_titles(titles, new_titles)
    missing = articles_missing_info(all_links, all_titles, db_name)
    return IngestResult(all_links, all_titles, new_useless, missing, item_counters(all_links))
