"""

Every builder takes (spark, sf_dir), reads the driver tables through the
fixture views and returns a DataFrame whose columns match the oracle SQL of
the same name (``litrank.oracle_sql``). Doubles are rounded to 6 digits only
at the output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrank import fixtures
from litrank.constants import KEY_F, KEY_PRECISION, KEY_RECALL, KEY_SCORE, KEY_SENTIMENT
from litrank.functions import metrics as M
from litrank.functions import text as TX
from litrank.functions import urls as U
from litrank.functions.metrics import r6
from litrank.operators import aggregates as A
from litrank.operators import containment as C
from litrank.operators import links as L
from litrank.operators import predicates as P
from litrank.operators import rank as R
from litrank.operators.budget import trim_to_budget
from litrank.operators.links import item_catalog
from litrank.operators.sentiment import clean_frame, sentiment_lexicon
from litrank.plans.batch_jobs import ingest, precompute_popular, score_corpus
from litrank.plans.output import article_rows, ranked_with_lists, respond, to_item_json
from litrank.plans.ranking import query_hits, rank_queries
from litrank.session import materialize, scratch_path
from litrank.sinks import writers as W
from litrank.sinks.versions import CounterTable, VersionedTable
from litrank.sources import readers as RD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _fx(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixtures.load(spark, sf_dir)


def _round_metrics(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 for the fixture query batch: titles corpus, fields title and id."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    catalog = item_catalog(fx["drugs"], fx["targets"])
    out = rank_queries(fx["queries"], corpus, fx["links"], fx["sentiments"], catalog,
                 rules=fx["rules"], fields=("title", "doi"))
    return _ranked(out)


register("b1_rank_items")(flagship)

CACHE_BUCKETS = 16


def _ranked(out: DataFrame) -> DataFrame:
    out = _round_metrics(out, ["precision", "recall", "f_0_5", "sentiment", "ranking_score", "p90"])
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("b1_cached_queries")
def q_b1_cached(spark, sf_dir):
    """B1 where every query is in the stored popular-query cache and the counters are stored: the
    corpus is not read, the links are scanned once for the links of Q."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    cache = W.write_popular(precompute_popular(fx["queries"], corpus, fields=("title", "doi")),
                            scratch_path(spark, "popular"), CACHE_BUCKETS)
    counters = CounterTable(spark, scratch_path(spark, "counters"))
    counters.rebuild(fx["links"], 1)
    return _ranked(rank_queries(fx["queries"], corpus, fx["links"], fx["sentiments"], item_catalog(fx["drugs"], fx["targets"]),
                                counters=counters.at(1), rules=fx["rules"], fields=("title", "doi"),
                                cache=spark.read.parquet(cache), cache_buckets=CACHE_BUCKETS))


@register("b1_documents")
def q_b1_documents(spark, sf_dir):
    """B1 over the texts of documents: links of two dictionaries ingested in two batches (J8, K3),
    counters kept by their deltas (A1), sentiments of the texts (T9), one query of the batch cached (J9)."""
    fx = _fx(spark, sf_dir)
    arts = fx["articles"]
    batches = [C.link_items(arts, fx[d])[0] for d in ("dictionary", "words")]
    counters = CounterTable(spark, scratch_path(spark, "counters"))
    links = None
    for number, batch in enumerate(batches, 1):
        links = W.append_links(links, batch)
        counters.add_batch(batch, number)
    scores = sentiment_lexicon(arts, fx["lexicon"], fx["stopwords"])
    sentiments = materialize(scores.select(F.col("doi").alias("pmid"), "sentiment_score"))
    q = fx["queries_docs"]
    cache = W.write_popular(precompute_popular(q.where("query_id = 2"), arts), scratch_path(spark, "popular"), CACHE_BUCKETS)
    catalog = item_catalog(fx["dictionary"], fx["words"])
    return _ranked(rank_queries(q, arts, links, sentiments, catalog, counters=counters.at(2), rules=fx["rules"],
                                cache=spark.read.parquet(cache), cache_buckets=CACHE_BUCKETS))


# ---------------------------------------------------------------- text

KEYWORD = "The of"


@register("t1_normalize_query")
def q_t1(spark, sf_dir):
    a = _fx(spark, sf_dir)["articles"]
    return a.select("doi", TX.normalize_query("abstract").alias("normalized"))


@register("t2_tokenize")
def q_t2(spark, sf_dir):
    a = _fx(spark, sf_dir)["articles"]
    t = TX.tokenize("abstract")
    return a.select("doi", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


@register("t3_match_all_tokens")
def q_t3(spark, sf_dir):
    a = _fx(spark, sf_dir)["articles"]
    kw = F.array_distinct(TX.tokenize(F.lit(KEYWORD)))
    return a.select("doi", TX.match_all_tokens(TX.tokenize("abstract"), kw).alias("matches"))


@register("t4_match_keywords")
def q_t4(spark, sf_dir):
    a = _fx(spark, sf_dir)["articles"]
    return C.match_keywords(a, [KEYWORD]).select("doi", "db_name")


def _title_hits(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    return C.match_batch(corpus, fx["queries"], fields=("title", "doi")).select(
        "query_id", F.col("doi").alias("pmid"))


@register("t5_match_batch")
def q_t5(spark, sf_dir):
    return _title_hits(spark, sf_dir)


@register("t5_match_index")
def q_t5_index(spark, sf_dir):
    """T5 over a stored token index (built once from the corpus, partitioned by
    token bucket; the lookup reads only its tokens' buckets)."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    # bucket count sized to the test tables; at 100 TB about 1 GB of pairs per bucket
    buckets = 32
    path = C.build_token_index(corpus, scratch_path(spark, "token-index"), fields=("title", "doi"),
                               buckets=buckets)
    idx = spark.read.parquet(path)
    return C.match_index(idx, fx["queries"], fields=("title", "doi"), buckets=buckets).select(
        "query_id", F.col("doi").alias("pmid"))


@register("t6_union_hits")
def q_t6(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    fx["queries"]
    q = spark.sql("SELECT query_id, query FROM queries UNION ALL "
                  "SELECT CAST(4 AS BIGINT), 'the of'")
    on_titles = C.match_batch(fx["titles"].select(F.col("pmid").alias("doi"), "title"), q,
                               fields=("title", "doi")).select("query_id", F.col("doi").alias("pmid"))
    on_articles = C.match_batch(fx["articles"], q).select("query_id", F.col("doi").alias("pmid"))
    return C.union_hits(on_titles, on_articles)


@register("t7_clean_text")
def q_t7(spark, sf_dir):
    a = _fx(spark, sf_dir)["articles"]
    return a.select("doi", TX.clean_text("abstract").alias("cleaned"))


@register("t8_remove_stopwords")
def q_t8(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return clean_frame(fx["articles"], fx["stopwords"])


@register("t9_sentiment_lexicon")
def q_t9(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = sentiment_lexicon(fx["articles"], fx["lexicon"], fx["stopwords"])
    return s.select("doi", r6("sentiment_score").alias("sentiment_score"))


# ------------------------------------------------- joins, predicates, aggregates


def _lq(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return L.restrict_links(fx["links"], _title_hits(spark, sf_dir))


def _metrics(spark, sf_dir, overrides=False):
    fx = _fx(spark, sf_dir)
    hits = _title_hits(spark, sf_dir)
    lq = L.restrict_links(fx["links"], hits)
    per_item = A.tp_and_sentiment(lq, fx["sentiments"])
    named = L.attach_names(per_item, item_catalog(fx["drugs"], fx["targets"]))
    m = A.item_metrics(named, A.item_counters(fx["links"]), A.query_size(hits))
    return R.apply_overrides(m, fx["queries"], fx["rules"]) if overrides else m


@register("j1_restrict_links")
def q_j1(spark, sf_dir):
    return _lq(spark, sf_dir).select("query_id", "pmid", "item_id", "item_type")


@register("j1_bucketed_links")
def q_j1_bucketed(spark, sf_dir):
    """J1 on links stored bucketed by pmid, with Q beyond the broadcast bound: only Q moves."""
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "links-bucketed")
    table = W.write_bucketed(fx["links"], "links_" + path.rsplit("-", 1)[1], buckets=16, path=path)
    return L.restrict_links(spark.table(table), _title_hits(spark, sf_dir), max_broadcast_hits=0) \
        .select("query_id", "pmid", "item_id", "item_type")


@register("j2_attach_names")
def q_j2(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    per_item = A.items_in_query(_lq(spark, sf_dir))
    return L.attach_names(per_item, item_catalog(fx["drugs"], fx["targets"]))


@register("j3_attach_totals")
def q_j3(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    per_item = A.items_in_query(_lq(spark, sf_dir))
    return L.attach_totals(per_item, A.item_counters(fx["links"]))


@register("j4_attach_article_info")
def q_j4(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return L.attach_article_info(fx["links"], fx["titles_known"])


@register("j5_attach_sentiment")
def q_j5(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    arts = A.per_article(_lq(spark, sf_dir))
    return L.attach_sentiment(arts, fx["sentiments"])


@register("j6_items_to_collect")
def q_j6(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    items = item_catalog(fx["drugs"], fx["targets"]).unionByName(fx["dictionary"])
    return L.items_to_collect(items, fx["links_db"], fx["useless"], "PubMed")


@register("j7_articles_missing_info")
def q_j7(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return L.articles_missing_info(fx["links_db"], fx["titles_known"])


@register("j8_link_items")
def q_j8(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    links, _ = C.link_items(fx["articles"], fx["dictionary"])
    return links


@register("j8_link_items_phrase")
def q_j8_phrase(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    links, _ = C.link_items(fx["articles"], fx["dictionary"], phrase=True)
    return links


@register("j9_lookup_popular")
def q_j9(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    cache = precompute_popular(fx["popular"], corpus, fields=("title", "doi"))
    hits, misses = L.lookup_popular(fx["queries"], cache)
    live = C.match_batch(corpus, misses, fields=("title", "doi")).select(
        "query_id", F.col("doi").alias("pmid"))
    return C.union_hits(hits, live)


@register("j10_orphan_links")
def q_j10(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return L.orphan_links(fx["links"], item_catalog(fx["drugs"], fx["targets"]))


@register("p1_links_where")
def q_p1(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.links_where(fx["links"], pmids=_title_hits(spark, sf_dir).select("pmid"),
                         item_type="target")


@register("p2_titles_where")
def q_p2(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.titles_where(fx["titles"], pmids=_title_hits(spark, sf_dir).select("pmid"))


@register("p3_sentiments_where")
def q_p3(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.sentiments_where(fx["sentiments"], pmids=_title_hits(spark, sf_dir).select("pmid"))


@register("p4_split_by_type")
def q_p4(spark, sf_dir):
    return P.split_by_type(_fx(spark, sf_dir)["links"], "target")


@register("p5_drop_unusable_links")
def q_p5(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.drop_unusable_links(fx["links"], fx["drug_catalog"])


@register("p6_db_filter")
def q_p6(spark, sf_dir):
    return P.db_filter(_fx(spark, sf_dir)["links_db"], "Crossref")


@register("p7_article_url")
def q_p7(spark, sf_dir):
    t = _fx(spark, sf_dir)["titles"]
    return t.select("pmid", U.article_url("db_name", "pmid", "url").alias("url"))


@register("p8_pdf_fields")
def q_p8(spark, sf_dir):
    t = _fx(spark, sf_dir)["titles"]
    return t.select("pmid", U.has_pdf("pmcid").alias("has_pdf"), U.pdf_url("pmcid").alias("pdf_url"))


@register("a1_item_counters")
def q_a1(spark, sf_dir):
    return A.item_counters(_fx(spark, sf_dir)["links"])


@register("a1_counters_by_deltas")
def q_a1_deltas(spark, sf_dir):
    """A1 kept by the links of each source as they are ingested; a batch that comes twice counts once."""
    links = _fx(spark, sf_dir)["links_db"]
    counters = CounterTable(spark, scratch_path(spark, "counters"))
    counters.rebuild(links.where("db_name = 'PubMed'"), 1)
    for number, source in ((2, "Crossref"), (2, "Crossref"), (3, "Xrxiv")):
        counters.add_batch(links.where(F.col("db_name") == source), number)
    return counters.at(3)


@register("a2_items_in_query")
def q_a2(spark, sf_dir):
    return A.items_in_query(_lq(spark, sf_dir))


@register("a3_collect_articles")
def q_a3(spark, sf_dir):
    """A3 as the engine uses it: article lists of the returned items, cut to
    the response budget (R5) before they are collected."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    asking = fx["queries"].withColumn("with_articles", F.lit(True))
    _, lists = ranked_with_lists(asking, corpus, fx["links"], fx["sentiments"],
                                 item_catalog(fx["drugs"], fx["targets"]), fx["titles"],
                                 rules=fx["rules"], fields=("title", "doi"))
    return lists.select("query_id", "item_type", "item_id",
                        F.size("articles").alias("n_articles"),
                        F.array_join(F.transform("articles", lambda a: a["pmid"]), ",").alias("pmids"),
                        F.size(F.filter("articles", lambda a: a["has_pdf"])).alias("n_pdf"))


@register("a3_unfiltered_articles")
def q_a3_whole(spark, sf_dir):
    """The article rows of unfiltered queries, with a budget that would cut their lists."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    catalog = item_catalog(fx["drugs"], fx["targets"])
    q = fx["queries_whole"]
    hits = materialize(query_hits(corpus, q, fields=("title", "doi")))
    ranked = rank_queries(q, corpus, fx["links"], fx["sentiments"], catalog, rules=fx["rules"],
                    fields=("title", "doi"), hits=hits, checkpoint_hits=False)
    rows = article_rows(ranked, hits, fx["links"], fx["titles"], q)
    return rows.select("query_id", "item_type", "item_id", "pmid", "title", "db_name", "url", "has_pdf", "pdf_url")


@register("a4_mean_sentiment")
def q_a4(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = A.mean_sentiment(_lq(spark, sf_dir), fx["sentiments"])
    return s.withColumn("sentiment", r6("sentiment"))


@register("a5_query_size")
def q_a5(spark, sf_dir):
    return A.query_size(_title_hits(spark, sf_dir))


@register("a6_precision_p90")
def q_a6(spark, sf_dir):
    p = A.precision_p90(materialize(_metrics(spark, sf_dir)), with_recall=True)
    return _round_metrics(p, ["p90", "r90"])


@register("a7_known_items")
def q_a7(spark, sf_dir):
    return A.known_items(_fx(spark, sf_dir)["links_db"], "Xrxiv")


@register("a8_unique_articles")
def q_a8(spark, sf_dir):
    return A.unique_articles(_fx(spark, sf_dir)["links_db"], "PubMed")


# ------------------------------------------------------------ metrics, ranking

METRICS_OUT = ["precision", "recall", "f_0_5", "sentiment", "ranking_score"]


@register("m1_confusion")
def q_m1(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("query_id", "item_type", "item_id",
                    M.true_positives("n_hit_item").alias("tp"),
                    M.false_positives("n_hit_item", "n_item").alias("fp"),
                    M.false_negatives("n_hit_item", "n_query").alias("fn"))


def _metric_column(name):
    def build(spark, sf_dir):
        m = _metrics(spark, sf_dir, overrides=False)
        return m.select("query_id", "item_type", "item_id", r6(name).alias(name))
    return build


register("m2_precision")(_metric_column("precision"))
register("m3_recall")(_metric_column("recall"))
register("m4_f_beta")(_metric_column("f_0_5"))
register("m5_ranking_score")(_metric_column("ranking_score"))


@register("m6_item_metrics")
def q_m6(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return _round_metrics(m.select("query_id", "item_type", "item_id", "name", "n_hit_item",
                                   "n_item", "n_query", *METRICS_OUT), METRICS_OUT)


@register("r1_apply_overrides")
def q_r1(spark, sf_dir):
    m = _metrics(spark, sf_dir, overrides=True)
    return m.select("query_id", "item_type", "item_id", "name", r6("ranking_score").alias("ranking_score"))


@register("r2_filter_above_p90")
def q_r2(spark, sf_dir):
    x = R.filter_above_p90(materialize(_metrics(spark, sf_dir)))
    return _round_metrics(x.select("query_id", "item_type", "item_id", "precision", "p90"),
                          ["precision", "p90"])


@register("r3_top_k_by_score")
def q_r3(spark, sf_dir):
    x = R.top_k_by_score(_metrics(spark, sf_dir, overrides=True), 50)
    return x.select("query_id", "item_type", "item_id", r6("ranking_score").alias("ranking_score"),
                    F.col("rank").cast("bigint").alias("rank"))


def _flagged_ranking(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    return rank_queries(fx["queries_flags"], corpus, fx["links"], fx["sentiments"],
                  item_catalog(fx["drugs"], fx["targets"]), rules=fx["rules"],
                  fields=("title", "doi"))


@register("r4_skip_filter_when_empty")
def q_r4(spark, sf_dir):
    x = _flagged_ranking(spark, sf_dir)
    return _round_metrics(x.select("query_id", "item_type", "item_id", *METRICS_OUT), METRICS_OUT)


R5_BUDGET = 300_000


@register("r5_trim_to_budget")
def q_r5(spark, sf_dir):
    """The items of each query with their metrics; items that the catalog lacks are a type of their
    own. Beside the rows that stay, each group has a row with its round alone."""
    fx = _fx(spark, sf_dir)
    lq = materialize(_lq(spark, sf_dir))
    catalog = item_catalog(fx["drugs"], fx["targets"])
    per_item = A.tp_and_sentiment(lq, fx["sentiments"]).join(catalog, ["item_type", "item_id"], "left")
    items = materialize(A.item_metrics(per_item, A.item_counters(fx["links"]), A.query_size(_title_hits(spark, sf_dir))))
    kind = F.when(F.col("name").isNull(), "orphan").otherwise(F.col("item_type"))
    info = L.attach_article_info(lq.join(items.select("query_id", "item_type", "item_id", "name"),
                                         ["query_id", "item_type", "item_id"]), fx["titles"])
    kept, rounds = trim_to_budget(info.withColumn("item_type", kind).drop("name"), items.withColumn("item_type", kind),
                                  budget_bytes=R5_BUDGET, with_rounds=True)
    none = F.lit(None).cast("string")
    rows = kept.select("query_id", "item_type", "item_id", "pmid", "rank", "trim_round", "over_budget").unionByName(
        rounds.select("query_id", "item_type", none.alias("item_id"), none.alias("pmid"),
                      F.lit(None).cast("bigint").alias("rank"), "trim_round", "over_budget"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "trim_round")})


@register("r6_sort_for_display")
def q_r6(spark, sf_dir):
    x = R.sort_for_display(flagship(spark, sf_dir))
    return x.select("query_id", "position", "item_id", "f_0_5")


# --------------------------------------------------------- sources and sinks


@register("s1_read_catalog")
def q_s1(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d_path, t_path = scratch_path(spark, "drugs-csv"), scratch_path(spark, "targets-csv")
    fx["drug_catalog"].write.option("header", True).csv(d_path)
    fx["target_catalog"].write.option("header", True).csv(t_path)
    return RD.read_catalog(spark, d_path, "drugbank_id", "drug").unionByName(
        RD.read_catalog(spark, t_path, "uniprot_id", "target"))


@register("s1_read_catalog_by_name")
def q_s1_by_name(spark, sf_dir):
    """Catalogs with columns in another order, extra columns, quotes in names, no type column."""
    fx = _fx(spark, sf_dir)
    quoted = F.concat(F.lit('the "'), "name", F.lit('", so called')).alias("name")
    d_path, n_path = scratch_path(spark, "drugs-csv"), scratch_path(spark, "untyped-csv")
    fx["drug_catalog"].select(F.lit("x").alias("extra"), "state", quoted, "type", "drugbank_id") \
        .write.option("header", True).option("escape", '"').csv(d_path)
    fx["drug_catalog"].select(quoted, F.concat(F.lit("U"), "drugbank_id").alias("drugbank_id"), "state") \
        .write.option("header", True).option("escape", '"').csv(n_path)
    return RD.read_catalog(spark, d_path, "drugbank_id", "drug").unionByName(
        RD.read_catalog(spark, n_path, "drugbank_id", "drug"))


@register("s2_make_items")
def q_s2(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return RD.make_items(fx["drug_catalog"], fx["target_catalog"])


def _write_dumps(spark, fx, name):
    """Articles as JSON lines, plus one file of broken lines derived from the
    benchmark table (they must land in _corrupt_record)."""
    path = scratch_path(spark, name)
    fx["articles"].select("title", "doi", "abstract").write.json(f"{path}/good")
    fixtures.table(spark, fx.sf_dir, "benchmark").select(
        F.concat(F.lit('{"doi": "B'), F.col("item_id").cast("string"), F.lit('", "title": ')).alias("v")
    ).write.text(f"{path}/broken")
    return path


@register("s3_read_dumps")
def q_s3(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = _write_dumps(spark, fx, "dumps")
    df = RD.read_dumps(spark, f"{path}/*")
    return df.select("doi", "title", "abstract", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@register("s4_dedup_articles")
def q_s4(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "dedup")
    a = fx["articles"]
    (a.where(F.col("db_name") == "PubMed")
      .select(F.concat(F.lit("["), "title", F.lit("]")).alias("title"), "doi", "abstract")
      .write.json(f"{path}/a"))
    a.select("title", "doi", "abstract").write.json(f"{path}/b")
    d = RD.dedup_articles(RD.read_dumps(spark, f"{path}/*").drop("_corrupt_record"))
    return d.select("doi", "title", "abstract")


def _esummary_raw(fx):
    t = fx["titles"]
    ids = F.filter(F.array(F.struct(F.lit("pubmed").alias("idtype"), F.col("pmid").alias("value")),
                           F.struct(F.lit("pmc").alias("idtype"), F.col("pmcid").alias("value"))),
                   lambda x: x["value"].isNotNull())
    doc = F.to_json(F.struct(F.col("pmid").alias("uid"), "title", ids.alias("articleids")))
    entry = F.concat(F.to_json(F.array("pmid")).substr(F.lit(2), F.length(F.to_json(F.array("pmid")))), F.lit(": "), doc)
    per = t.withColumn("_chunk", (F.col("pmid").cast("bigint") / 100).cast("bigint")) \
           .withColumn("_e", F.regexp_replace(entry, r"\]: ", ": "))
    return per.groupBy("_chunk").agg(
        F.concat(F.lit('{"result": {"uids": '), F.to_json(F.array_sort(F.collect_list("pmid"))),
                 F.lit(", "), F.concat_ws(", ", F.collect_list("_e")), F.lit("}}")).alias("value"))


@register("s5_flatten_esummary")
def q_s5(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "esummary")
    _esummary_raw(fx).select("value").write.text(path)
    return RD.flatten_esummary(RD.read_text(spark, path))


@register("s5_flatten_esummary_xml")
def q_s5_xml(spark, sf_dir):
    """S5 over the XML form: DocSum records written by Spark's XML writer."""
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "esummary-xml")
    t = fx["titles"]
    item = "struct<_Name:string,_VALUE:string,Item:array<struct<_Name:string,_VALUE:string>>>"
    ids = F.filter(F.array(F.struct(F.lit("pubmed").alias("_Name"), F.col("pmid").alias("_VALUE")),
                           F.struct(F.lit("pmc").alias("_Name"), F.col("pmcid").alias("_VALUE"))),
                   lambda x: x["_VALUE"].isNotNull())
    items = F.array(
        F.struct(F.lit("Title").alias("_Name"), F.col("title").alias("_VALUE"),
                 F.lit(None).cast("array<struct<_Name:string,_VALUE:string>>").alias("Item")),
        F.struct(F.lit("ArticleIds").alias("_Name"), F.lit(None).cast("string").alias("_VALUE"),
                 ids.alias("Item"))).cast(f"array<{item}>")
    (t.select(F.col("pmid").alias("Id"), items.alias("Item")).write.format("xml")
      .option("rootTag", "eSummaryResult").option("rowTag", "DocSum").save(path))
    return RD.flatten_esummary_xml(spark, path)


@register("s6_flatten_crossref")
def q_s6(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "crossref")
    t = fx["titles"].withColumn("_chunk", (F.col("pmid").cast("bigint") / 100).cast("bigint"))
    title = F.when(F.col("pmcid").isNull(), F.array().cast("array<string>")).otherwise(F.array("title"))
    item = F.struct(F.col("pmid").alias("DOI"), title.alias("title"), F.col("url").alias("URL"))
    raw = t.groupBy("_chunk").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items"))
                                                     .alias("message"))).alias("value"))
    raw.select("value").write.text(path)
    return RD.flatten_crossref(RD.read_text(spark, path))


@register("s7_flatten_pubmed_xml")
def q_s7(spark, sf_dir):
    path = scratch_path(spark, "efetch")
    o = fixtures.table(spark, sf_dir, "orders")
    parts = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("array<string>")).otherwise(
        F.array("o_orderstatus", "o_orderpriority"))
    article = F.struct(F.col("o_orderpriority").alias("ArticleTitle"),
                       F.when(parts.isNotNull(), F.struct(parts.alias("AbstractText"))).alias("Abstract"))
    rec = F.struct(F.col("o_orderkey").cast("string").alias("PMID"), article.alias("Article"))
    (o.select(rec.alias("MedlineCitation")).write.format("xml")
      .option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path))
    return RD.flatten_pubmed_xml(spark, path)


@register("s8_scan_table")
def q_s8(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "titles-table")
    W.write_table(fx["titles"], path, cluster_by="pmid", sort_within=["pmid"])
    return RD.scan_table(spark, path)


@register("k1_write_hits")
def q_k1(spark, sf_dir):
    path = W.write_hits(_title_hits(spark, sf_dir), scratch_path(spark, "hits"))
    return spark.read.schema("query_id bigint, pmid string").json(path)


def _title_batch(fx):
    o = fixtures.table(fx.spark, fx.sf_dir, "orders")
    src = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'Crossref' ELSE 'Xrxiv' END")
    key = F.col("o_orderkey").cast("string")
    ins = o.where(F.col("o_orderstatus") == "P").select(
        key.alias("pmid"), src.alias("db_name"), F.lit(None).cast("string").alias("url"),
        F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("pmcid"),
        F.lit(1).alias("seq"))
    upd_old = o.where(F.col("o_orderstatus") == "O").select(
        key.alias("pmid"), src.alias("db_name"), F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("old "), "o_orderpriority").alias("title"), F.lit(None).cast("string").alias("pmcid"),
        F.lit(1).alias("seq"))
    upd_new = upd_old.withColumn("title", F.lower(F.col("title"))).withColumn("seq", F.lit(2))
    return ins.unionByName(upd_old).unionByName(upd_new)


@register("k2_upsert_titles")
def q_k2(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return W.upsert_titles(fx["titles"], _title_batch(fx), order_col="seq")


@register("k2_titles_versions")
def q_k2_versions(spark, sf_dir):
    """K2 as two versions of a table; a reader resolves the current one."""
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "titles-versions")
    writer = VersionedTable(spark, path)
    first = writer.commit(fx["titles"], 0)
    writer.commit(W.upsert_titles(writer.read(), _title_batch(fx), order_col="seq"), first)
    return VersionedTable(spark, path).read()


@register("k3_append_links")
def q_k3(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    new, _ = C.link_items(fx["articles"], fx["dictionary"])
    again = fx["links_db"].where(F.col("db_name") == "Xrxiv")
    return W.append_links(fx["links_db"], new.unionByName(again), mode="distinct")


@register("k4_replace_counters")
def q_k4(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "counters")
    stale = A.item_counters(fx["links"].where(F.col("item_type") == "drug"))
    W.replace_counters(stale, path)
    return RD.scan_table(spark, W.replace_counters(A.item_counters(fx["links"]), path))


@register("k5_upsert_sentiments")
def q_k5(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = sentiment_lexicon(fx["articles"], fx["lexicon"], fx["stopwords"])
    new = s.select(F.col("doi").alias("pmid"), "sentiment_score")
    out = W.upsert_sentiments(fx["sentiments"], new)
    return out.withColumn("sentiment_score", r6("sentiment_score"))


@register("k6_upsert_popular_queries")
def q_k6(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    base = precompute_popular(fx["popular"], corpus, fields=("title", "doi"))
    return precompute_popular(fx["queries"], corpus, cache=base, fields=("title", "doi"))


@register("k7_append_dump")
def q_k7(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "dated-dumps")
    a = fx["articles"]
    W.append_dump(a.where(F.col("db_name") == "PubMed"), path, "2024-01-01")
    W.append_dump(a.where(F.col("db_name") != "PubMed"), path, "2024-01-02")
    d = spark.read.schema("abstract string, title string, doi string, dump_date string").json(path)
    return d.select("doi", "title", "abstract", "dump_date")


# ------------------------------------------------------------- composites


@register("b2_precompute_popular")
def q_b2(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    return precompute_popular(fx["popular"], corpus, fields=("title", "doi"))


@register("b3_score_corpus")
def q_b3(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    path = scratch_path(spark, "score-dumps")
    a = fx["articles"]
    a.select("title", "doi", "abstract").write.json(f"{path}/a")
    (a.where(F.col("db_name") == "PubMed")
      .select("title", "doi", F.concat(F.lit("the is "), "abstract").alias("abstract"))
      .write.json(f"{path}/b"))
    dumps = RD.read_dumps(spark, f"{path}/*").drop("_corrupt_record")
    out = score_corpus(dumps, fx["lexicon"], fx["stopwords"], base=fx["sentiments"])
    return out.withColumn("sentiment_score", r6("sentiment_score"))


def _ingest(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return ingest(fx["articles"].select("doi", "title", "abstract"), fx["dictionary"], fx["links_db"],
                  fx["titles_known"], fx["useless"], "Xrxiv")


@register("b4_ingest")
def q_b4(spark, sf_dir):
    return _ingest(spark, sf_dir).counters


@register("b4_ingest_links")
def q_b4_links(spark, sf_dir):
    return _ingest(spark, sf_dir).links.select("pmid", "db_name", "item_id", "item_type")


@register("b4_ingest_titles")
def q_b4_titles(spark, sf_dir):
    return _ingest(spark, sf_dir).titles.select("pmid", "db_name", "url", "title", "pmcid")


@register("b4_ingest_useless")
def q_b4_useless(spark, sf_dir):
    return _ingest(spark, sf_dir).useless.select("db_name", "item_id")


@register("b4_ingest_missing_info")
def q_b4_missing(spark, sf_dir):
    return _ingest(spark, sf_dir).missing_info.select("pmid")


@register("t5_match_repeated_ids")
def q_t5_repeated(spark, sf_dir):
    """A corpus that repeats every third id, with the tokens of a query split over the two rows."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title", F.lit("a").alias("file_path"))
    first = F.col("doi").cast("bigint") % 3 == 0
    split = corpus.where(first).select("doi", F.regexp_replace("title", "not", "").alias("title"),
                                       F.lit("b").alias("file_path"))
    cut = corpus.withColumn("title", F.when(first, F.regexp_replace("title", "specified", "")).otherwise(F.col("title")))
    return query_hits(cut.unionByName(split), fx["queries"], fields=("title", "doi"))


@register("o1_result_entries")
def q_o1_entries(spark, sf_dir):
    """The content of the JSON results: every item in its order, all metrics, every article field."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    res = respond(fx["queries_flags"], corpus, fx["links"], fx["sentiments"],
                  item_catalog(fx["drugs"], fx["targets"]), fx["titles"], rules=fx["rules"], fields=("title", "doi"))
    article = "struct<pmid:string,title:string,db_name:string,url:string,has_pdf:boolean,pdf_url:string>"
    entry = f"struct<counter:bigint,item_pmids:array<{article}>,metrics:map<string,double>>"
    j = res.select("query_id", F.from_json("result", f"struct<drugs:map<string,{entry}>,targets:map<string,{entry}>>").alias("j"))
    rows = j.select("query_id", F.lit("drug").alias("item_type"), F.posexplode("j.drugs").alias("pos", "name", "e")) \
        .unionByName(j.select("query_id", F.lit("target").alias("item_type"),
                              F.posexplode("j.targets").alias("pos", "name", "e")))
    text = F.transform("e.item_pmids", lambda a: F.concat_ws("|", a["pmid"], a["title"], a["db_name"], a["url"],
                                                             a["has_pdf"].cast("string"), a["pdf_url"]))
    return rows.select(
        "query_id", "item_type", (F.col("pos") + 1).cast("bigint").alias("position"), "name", "e.counter",
        r6(F.col("e.metrics")[F.lit(KEY_PRECISION)]).alias("precision"), r6(F.col("e.metrics")[F.lit(KEY_RECALL)]).alias("recall"),
        r6(F.col("e.metrics")[F.lit(KEY_F)]).alias("f_0_5"), r6(F.col("e.metrics")[F.lit(KEY_SENTIMENT)]).alias("sentiment"),
        r6(F.col("e.metrics")[F.lit(KEY_SCORE)]).alias("ranking_score"),
        F.coalesce(F.array_join(text, ";"), F.lit("")).alias("articles"))


@register("o1_item_json")
def q_o1_items(spark, sf_dir):
    """The items of unfiltered queries, one JSON value for each."""
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    ranked = rank_queries(fx["queries_flags"], corpus, fx["links"], fx["sentiments"],
                          item_catalog(fx["drugs"], fx["targets"]), rules=fx["rules"], fields=("title", "doi"))
    rows = to_item_json(ranked, fx["queries_flags"]).select(
        "query_id", "item_type", "name", F.from_json("result", "struct<counter:bigint,metrics:map<string,double>>").alias("e"))
    return rows.select(
        "query_id", "item_type", "name", "e.counter",
        r6(F.col("e.metrics")[F.lit(KEY_PRECISION)]).alias("precision"), r6(F.col("e.metrics")[F.lit(KEY_RECALL)]).alias("recall"),
        r6(F.col("e.metrics")[F.lit(KEY_F)]).alias("f_0_5"), r6(F.col("e.metrics")[F.lit(KEY_SENTIMENT)]).alias("sentiment"),
        r6(F.col("e.metrics")[F.lit(KEY_SCORE)]).alias("ranking_score"))


@register("o1_to_result_json")
def q_o1(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    q = fx["queries_flags"]
    res = respond(q, corpus, fx["links"], fx["sentiments"], item_catalog(fx["drugs"], fx["targets"]),
                  fx["titles"], rules=fx["rules"], fields=("title", "doi"))
    typ = ("struct<drugs:map<string,struct<counter:bigint,item_pmids:array<struct<pmid:string>>>>,"
           "targets:map<string,struct<counter:bigint,item_pmids:array<struct<pmid:string>>>>>")
    p = res.select("query_id", "result", F.from_json("result", typ).alias("j"))

    def total(m, f):
        return F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda acc, v: acc + f(v))
    return p.select(
        "query_id",
        F.size(F.map_keys("j.drugs")).alias("n_drugs"),
        F.size(F.map_keys("j.targets")).alias("n_targets"),
        F.array_join(F.array_sort(F.map_keys("j.drugs")), "|").alias("drug_names"),
        (total("j.drugs", lambda v: v["counter"]) + total("j.targets", lambda v: v["counter"])).alias("counters"),
        (total("j.drugs", lambda v: F.coalesce(F.size(v["item_pmids"]), F.lit(0)).cast("bigint"))
         + total("j.targets", lambda v: F.coalesce(F.size(v["item_pmids"]), F.lit(0)).cast("bigint"))
         ).alias("n_pmids"),
        F.col("result").contains('"item_pmids"').alias("with_pmids"))
