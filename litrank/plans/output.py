"""Article lists (A3 + J4 + R5) and the nested JSON result (O1).

Only returned items get article lists, and only queries that ask for them
(``with_articles``). Lists are cut by the response budget before they are
collected, so the largest collected value is bounded by the budget, not by
the number of links of a hot item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.constants import (BUDGET_BYTES, KEY_F, KEY_ITEM_PUBS, KEY_PRECISION, KEY_RECALL,
                               KEY_SCORE, KEY_HIT_PUBS, KEY_SENTIMENT)
from litrank.operators.aggregates import collect_articles
from litrank.operators.budget import METRICS, trim_to_budget
from litrank.operators.joins import broadcastable
from litrank.operators.links import MAX_BROADCAST_HITS, attach_article_info, restrict_links
from litrank.session import materialize

ARTICLE_TYPE = ("array<struct<pmid:string,title:string,db_name:string,url:string,"
                "has_pdf:boolean,pdf_url:string>>")


def article_lists(ranked: DataFrame, hits: DataFrame, links: DataFrame, titles: DataFrame,
                  queries: DataFrame | None = None, budget_bytes: int = BUDGET_BYTES,
                  collect_unfiltered: bool = False, by_name: bool = False) -> DataFrame:
    """(query_id, item_type, item_id, articles) for the returned items.

    Links of Q (J1) restricted to returned items, metadata attached (J4), cut
    to the budget (R5), then collected sorted by pmid (A3). The lists of queries
    with ``do_filter`` false are not cut, and an item of theirs may have more
    articles than a value should hold: take them from ``article_rows``. Only
    ``collect_unfiltered=True`` collects them here. With ``by_name`` items that
    share a name are one entry, that of the largest id, as in the JSON (O1).
    """
    items = ranked.select("query_id", "item_type", "item_id", "name", *[c for c, _ in METRICS.values()])
    if by_name:
        rest = F.struct(*[c for c in items.columns if c not in ("query_id", "item_type", "name")])
        items = items.groupBy("query_id", "item_type", "name").agg(F.max_by(rest, "item_id").alias("_i")) \
            .select("query_id", "item_type", "name", "_i.*")
    h = hits
    if queries is not None and "with_articles" in queries.columns:
        wanted = queries.where(F.coalesce("with_articles", F.lit(False))).select("query_id")
        h = h.join(wanted, "query_id", "left_semi")
        items = items.join(wanted, "query_id", "left_semi")
    # the returned items (at most k per query and type) feed two branches: store once
    items = materialize(items)
    lq = restrict_links(links.select("pmid", "item_id", "item_type"), h)
    lq = lq.join(items.select("query_id", "item_type", "item_id"),
                 ["query_id", "item_type", "item_id"], "left_semi")
    # metadata only for the articles of Q (broadcast semi join in the titles scan); a Q beyond the
    # bound cuts nothing, the join with its links then moves the titles once
    t = titles
    if broadcastable(h.select("pmid"), MAX_BROADCAST_HITS):
        t = titles.join(F.broadcast(h.select("pmid")), "pmid", "left_semi")
    info = attach_article_info(lq, t)
    if queries is None or "do_filter" not in queries.columns:
        return collect_articles(trim_to_budget(info, items, budget_bytes=budget_bytes))
    whole = queries.where(~F.coalesce("do_filter", F.lit(True))).select("query_id")
    cut = trim_to_budget(info.join(whole, "query_id", "left_anti"), items.join(whole, "query_id", "left_anti"),
                         budget_bytes=budget_bytes)
    lists = collect_articles(cut)
    if not collect_unfiltered:
        return lists
    return lists.unionByName(collect_articles(info.join(whole, "query_id", "left_semi")))


def article_rows(ranked: DataFrame, hits: DataFrame, links: DataFrame, titles: DataFrame,
                 queries: DataFrame) -> DataFrame:
    """The articles of unfiltered queries (``do_filter`` false, ``with_articles`` true) in long
    form, one row per (query, item, article): nothing is cut and nothing is collected."""
    wanted = queries.where(F.coalesce("with_articles", F.lit(False)) & ~F.coalesce("do_filter", F.lit(True)))
    wanted = wanted.select("query_id")
    h = hits.join(wanted, "query_id", "left_semi")
    items = ranked.select("query_id", "item_type", "item_id").join(wanted, "query_id", "left_semi")
    lq = restrict_links(links.select("pmid", "item_id", "item_type"), h)
    lq = lq.join(items, ["query_id", "item_type", "item_id"], "left_semi")
    return attach_article_info(lq, titles)


def _metrics():
    """The metrics of an item under their fixed JSON keys."""
    return F.struct(F.col("n_hit_item").alias(KEY_HIT_PUBS),
                    F.col("n_item").alias(KEY_ITEM_PUBS),
                    F.col("precision").alias(KEY_PRECISION),
                    F.col("recall").alias(KEY_RECALL),
                    F.col("f_0_5").alias(KEY_F),
                    F.col("sentiment").alias(KEY_SENTIMENT),
                    F.col("ranking_score").alias(KEY_SCORE))


def to_item_json(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """O1 of unfiltered queries (``do_filter`` false) item by item: (query_id, item_type, name,
    result) with result ``{"counter", "metrics"}``, the value that the item has in the JSON of
    ``to_result_json``, whatever the number of items. Items that share a name are one, that of
    the largest id; their articles are rows of ``article_rows``."""
    wanted = queries.where(~F.coalesce("do_filter", F.lit(True))).select("query_id")
    value = F.struct(F.col("n_hit_item").alias("counter"), _metrics().alias("metrics"))
    per_name = ranked.join(wanted, "query_id", "left_semi").groupBy("query_id", "item_type", "name") \
        .agg(F.max_by(value, "item_id").alias("_v"))
    return per_name.select("query_id", "item_type", "name",
                           F.to_json("_v", {"ignoreNullFields": "false"}).alias("result"))


def to_result_json(ranked: DataFrame, queries: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """O1: (query_id, result) with result
    ``{"drugs": {name: {counter, [item_pmids], metrics}}, "targets": {...}}``.

    Items sharing a name collapse to the one with the largest item_id (the
    reference keys by name and the last id wins). Queries without any item get
    two empty maps. ``item_pmids`` is present only for queries asking for it.
    An unfiltered query may have more items than one value should hold: ``to_item_json``
    gives them as rows.
    """
    x = ranked
    if articles is not None:
        x = x.join(articles, ["query_id", "item_type", "item_id"], "left")
    else:
        x = x.withColumn("articles", F.lit(None).cast(ARTICLE_TYPE))
    value = F.struct(F.col("n_hit_item").alias("counter"),
                     F.coalesce("articles", F.array().cast(ARTICLE_TYPE)).alias("item_pmids"),
                     _metrics().alias("metrics"))
    # by falling score, as R3 orders them; unfiltered queries have no rank
    place = F.struct(F.col("ranking_score").isNull().alias("none"), (-F.col("ranking_score")).alias("score"), "item_id")
    per_name = x.groupBy("query_id", "item_type", "name").agg(
        F.max_by(F.struct(place.alias("place"), value.alias("v")), F.col("item_id")).alias("_e"))
    per_type = per_name.groupBy("query_id", "item_type").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_e.place").alias("place"), F.col("name"),
                                             F.col("_e.v").alias("v")))).alias("_items"))
    entries = F.transform("_items", lambda e: F.struct(e["name"].alias("key"), e["v"].alias("value")))
    per_type = per_type.select("query_id", "item_type", F.map_from_entries(entries).alias("_m"))
    per_query = per_type.groupBy("query_id").agg(
        F.first(F.when(F.col("item_type") == "drug", F.col("_m")), ignorenulls=True).alias("drugs"),
        F.first(F.when(F.col("item_type") == "target", F.col("_m")), ignorenulls=True).alias("targets"))
    wa = F.coalesce("with_articles", F.lit(False)) if "with_articles" in queries.columns else F.lit(False)
    if "do_filter" in queries.columns:
        wa = wa & F.coalesce("do_filter", F.lit(True))
    q = queries.select("query_id", wa.alias("_wa"))
    out = q.join(per_query, ["query_id"], "left")
    empty = F.create_map().cast(per_type.schema["_m"].dataType)
    drugs = F.coalesce("drugs", empty)
    targets = F.coalesce("targets", empty)
    slim = lambda m: F.transform_values(m, lambda k, v: v.dropFields("item_pmids"))
    opts = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(drugs.alias("drugs"), targets.alias("targets")), opts)
    short = F.to_json(F.struct(slim(drugs).alias("drugs"), slim(targets).alias("targets")), opts)
    return out.select("query_id", F.when(F.col("_wa"), full).otherwise(short).alias("result"))


def ranked_with_lists(queries: DataFrame, corpus: DataFrame, links: DataFrame, sentiments: DataFrame,
                      catalog: DataFrame, titles: DataFrame, counters: DataFrame | None = None,
                      rules: DataFrame | None = None, k: int | None = None, id_col: str = "doi",
                      fields=None, budget_bytes: int = BUDGET_BYTES, collect_unfiltered: bool = False,
                      by_name: bool = False):
    """B1 and the article lists of its returned items: ``(ranked, lists)``.

    Q and the ranked items (at most k per query and type, or all items of a
    query with ``do_filter`` false) are checkpointed once, because the ranking,
    the article lists and the JSON all read them.
    """
    from litrank.constants import TOP_K
    from litrank.plans.ranking import query_hits, rank_queries

    hits = materialize(query_hits(corpus, queries, id_col, fields))
    ranked = rank_queries(queries, corpus, links, sentiments, catalog, counters=counters, rules=rules,
                    k=k or TOP_K, id_col=id_col, fields=fields, hits=hits, checkpoint_hits=False)
    ranked = materialize(ranked)
    return ranked, article_lists(ranked, hits, links, titles, queries, budget_bytes, collect_unfiltered, by_name)


def respond(queries: DataFrame, corpus: DataFrame, links: DataFrame, sentiments: DataFrame,
            catalog: DataFrame, titles: DataFrame, counters: DataFrame | None = None,
            rules: DataFrame | None = None, k: int | None = None, id_col: str = "doi",
            fields=None, budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """B1 + article lists + O1: the service's whole answer, (query_id, result).

    The lists of a query with ``do_filter`` false have no bound, so they are not
    put into its one JSON value: take them from ``article_rows``."""
    ranked, lists = ranked_with_lists(queries, corpus, links, sentiments, catalog, titles, counters,
                                      rules, k, id_col, fields, budget_bytes, by_name=True)
    return to_result_json(ranked, queries, lists)
