"""B1: rank catalog items for a whole table of queries at once.

Plan shape:

    corpus --tokens--> pairs --bcast(query tokens)--> Q(query_id, pmid)     [shuffle: query, article]
    Q is checkpointed (it feeds J1 and |Q|)
    links --bcast(Q) when its row count is within the bound--> links of Q   [no shuffle of links]
          --> distinct (query, item, article)                              [shuffle: query, type, item, pmid]
          --> left join sentiments cut to Q (bcast semi join in their scan)
          --> per item TP + mean sentiment                                 [shuffle: query, type, item]
    + counters (A1), |Q|, names, rules, flags: size-checked or AQE-measured broadcasts
    --> metrics, stored --> overrides --> p90 of distinct counts, top-k with group limit   [shuffle: query, type]

Beyond the broadcast bound J1 is a sort-merge join on pmid; store links and
sentiments bucketed by pmid (``write_bucketed``) so their side does not move.
The per-item counter table (A1) is a scan of the whole link table; pass a
stored one (K4) to skip it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.constants import TOP_K
from litrank.operators.aggregates import item_counters, item_metrics, query_size, tp_and_sentiment
from litrank.operators.containment import match_batch, union_hits
from litrank.operators.joins import join_bounded
from litrank.operators.links import attach_names, lookup_popular, restrict_links
from litrank.operators.rank import apply_overrides, rank_items
from litrank.session import materialize
from litrank.sources.readers import dedup_articles

METRIC_COLS = ["n_hit_item", "n_item", "precision", "recall", "f_0_5", "sentiment",
               "ranking_score"]


def query_hits(corpus: DataFrame, queries: DataFrame, id_col: str = "doi",
               fields: Sequence[str] | None = None, index: DataFrame | None = None,
               index_buckets: int | None = None, dedup: bool = True, cache: DataFrame | None = None,
               cache_buckets: int | None = None) -> DataFrame:
    """Q for every query: (query_id, pmid), distinct. With a stored token
    ``index`` (``build_token_index``) only its matching buckets are read.
    Of corpus rows with one id the first is matched (S4); pass
    ``dedup=False`` for a corpus that has unique ids. With a popular-query ``cache`` (J9) only
    its misses are matched; if there are none the corpus is not read at all."""
    if cache is not None:
        hits, misses = lookup_popular(queries, cache, cache_buckets)
        misses = materialize(misses)
        if misses.isEmpty():
            return hits
        live = query_hits(corpus, misses, id_col, fields, index, index_buckets, dedup)
        return union_hits(hits, live)
    if index is not None:
        from litrank.operators.containment import INDEX_BUCKETS, match_index
        h = match_index(index, queries, id_col=id_col, fields=fields,
                         buckets=index_buckets or INDEX_BUCKETS)
    else:
        h = match_batch(dedup_articles(corpus, key=id_col) if dedup else corpus, queries,
                         id_col=id_col, fields=fields)
    return h.select("query_id", F.col(id_col).cast("string").alias("pmid"))


def score_items(hits: DataFrame, links: DataFrame, sentiments: DataFrame,
                catalog: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """J1 -> A2/A4 (one pass) -> J2 -> J3 -> M6, one row per (query, item)."""
    if counters is None:
        counters = item_counters(links)
    links_q = restrict_links(links.select("pmid", "item_id", "item_type"), hits)
    per_item = tp_and_sentiment(links_q, sentiments, q_pmids=hits)
    named = attach_names(per_item, catalog)
    return item_metrics(named, counters, query_size(hits))


def rank_queries(queries: DataFrame, corpus: DataFrame, links: DataFrame, sentiments: DataFrame,
           catalog: DataFrame, counters: DataFrame | None = None, rules: DataFrame | None = None,
           k: int = TOP_K, id_col: str = "doi", fields: Sequence[str] | None = None,
           hits: DataFrame | None = None, checkpoint_hits: bool = True,
           index: DataFrame | None = None, index_buckets: int | None = None, cache: DataFrame | None = None,
           cache_buckets: int | None = None) -> DataFrame:
    """B1 long form: (query_id, item_type, item_id, name, metrics..., rank).

    ``queries`` has (query_id, query) and optionally ``do_filter`` (default
    true). ``hits`` may be given; otherwise the corpus (or its stored token
    ``index``) is matched, for the queries that the popular-query ``cache``
    (J9) lacks. ``counters`` are those kept by ``CounterTable``; without them
    the whole link table is counted. Q is checkpointed once because two
    branches read it.
    """
    if hits is None:
        hits = query_hits(corpus, queries, id_col, fields, index=index, index_buckets=index_buckets, cache=cache,
                          cache_buckets=cache_buckets)
    if checkpoint_hits:
        # Q feeds J1 and |Q|: match the corpus once, not once per branch.
        hits = materialize(hits)
    scored = score_items(hits, links, sentiments, catalog, counters)
    scored = materialize(scored)        # read by R1, by the quantile and by the filter
    scored = apply_overrides(scored, queries, rules)
    if "do_filter" in queries.columns:
        flags = queries.select("query_id", F.coalesce(F.col("do_filter"), F.lit(True)).alias("do_filter"))
        scored = join_bounded(scored, flags, ["query_id"])
        ranked = rank_items(scored, k, "do_filter").drop("do_filter")
    else:
        ranked = rank_items(scored, k)
    return ranked.select("query_id", "item_type", "item_id", "name", *METRIC_COLS, "p90", "rank")
