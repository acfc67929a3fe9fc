"""Metrics, aggregates and ranking hand cases (FIXTURES.md section 3)."""
import random

import pytest
from pyspark.sql import functions as F

from litrank.functions import metrics as M
from litrank.operators import aggregates as A
from litrank.operators import rank as R
from litrank.operators.budget import rank_in_groups, trim_to_budget


def test_metric_formulas(spark):
    df = spark.createDataFrame([(2, 4, 8, 0.5)], "tp long, total long, q long, s double")
    r = df.select(M.precision("tp", "total").alias("p"), M.recall("tp", "q").alias("r")) \
          .select("p", "r", M.f_beta("p", "r").alias("f")) \
          .select("p", "r", "f", M.ranking_score("f", F.lit(0.5)).alias("score")).first()
    assert r.p == 0.5 and r.r == 0.25
    assert r.f == pytest.approx(5 * 0.125 / 0.75)
    assert r.score == pytest.approx((4 * r.f + 0.5) / 5)


def test_recall_above_one_on_duplicate_links(spark):
    df = spark.createDataFrame([(3, 2)], "tp long, q long")
    assert df.select(M.recall("tp", "q")).first()[0] == 1.5


def test_mean_sentiment_distinct_articles(spark):
    lq = spark.createDataFrame([(1, "drug", "d", "a"), (1, "drug", "d", "a"), (1, "drug", "d", "b"),
                                (1, "drug", "e", "z")],
                               "query_id long, item_type string, item_id string, pmid string")
    s = spark.createDataFrame([("a", 0.5), ("b", -0.5)], "pmid string, sentiment_score double")
    got = {r.item_id: r.sentiment for r in A.mean_sentiment(lq, s).collect()}
    assert got == {"d": 0.0, "e": 0.0}
    both = {r.item_id: (r.n_hit_item, r.sentiment) for r in A.tp_and_sentiment(lq, s).collect()}
    assert both == {"d": (3, 0.0), "e": (1, 0.0)}


def test_scores_meet_the_links_of_many_hits_without_a_semi_join(spark, monkeypatch):
    """Q beyond the broadcast bound: the scores move once, by the left join alone."""
    lq = spark.createDataFrame([(1, "drug", f"d{i % 3}", str(i % 11)) for i in range(60)] + [(1, "drug", "d1", None)],
                               "query_id long, item_type string, item_id string, pmid string")
    s = spark.createDataFrame([(str(i), 0.5 if i % 2 else -0.5) for i in range(30)] + [(None, 0.5)],
                              "pmid string, sentiment_score double")
    hits = spark.createDataFrame([(1, str(i)) for i in range(11)], "query_id long, pmid string")
    want = sorted(map(tuple, A.tp_and_sentiment(lq, s, q_pmids=hits).collect()))
    monkeypatch.setattr(A, "MAX_BROADCAST_HITS", 0)
    far = A.tp_and_sentiment(lq, s, q_pmids=hits)
    assert sorted(map(tuple, far.collect())) == want and len(want) == 3
    assert "LeftSemi" not in far._jdf.queryExecution().optimizedPlan().toString()


def test_percentile_linear(spark):
    df = spark.createDataFrame([(1, "d", float(x)) for x in (1, 2, 3, 4)],
                               "query_id long, item_type string, precision double")
    assert A.precision_p90(df).first().p90 == pytest.approx(3.7)


def _items(spark, rows):
    return spark.createDataFrame(rows, "query_id long, item_type string, item_id string, name string, "
                                       "precision double, ranking_score double")


def test_overrides(spark):
    items = _items(spark, [(1, "drug", "d1", "Ivermectin", 0.1, 0.2), (1, "target", "t1", "Ivermectin", 0.1, 0.2),
                           (2, "drug", "d1", "Ivermectin", 0.1, 0.2)])
    q = spark.createDataFrame([(1, "Omicron wave"), (2, "flu")], "query_id long, query string")
    got = {(r.query_id, r.item_type): r.ranking_score for r in R.apply_overrides(items, q).collect()}
    assert got == {(1, "drug"): 1.0, (1, "target"): 0.2, (2, "drug"): 0.2}


def test_p90_filter_single_item_and_ties(spark):
    one = _items(spark, [(1, "drug", "a", "a", 0.5, 1.0)])
    assert R.filter_above_p90(one).count() == 0
    same = _items(spark, [(1, "drug", x, x, 0.5, 1.0) for x in "abc"])
    assert R.filter_above_p90(same).count() == 0


def test_top_k_ties_by_item_id(spark):
    items = _items(spark, [(1, "drug", "w", "w", 0.0, 2.0), (1, "drug", "x", "x", 0.0, 2.0),
                           (1, "drug", "y", "y", 0.0, 3.0)])
    got = [r.item_id for r in R.top_k_by_score(items, 2).orderBy("rank").collect()]
    assert got == ["y", "w"]


def test_do_filter_false_keeps_everything(spark):
    items = _items(spark, [(1, "drug", x, x, float(i), 1.0) for i, x in enumerate("abcdef")]) \
        .withColumn("do_filter", F.lit(False))
    assert R.rank_items(items, 2, "do_filter").count() == 6


def test_rank_in_groups_equals_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).select((F.col("id") % 3 == 0).cast("int").alias("g"),
                                     F.format_string("%05d", (F.col("id") * 7919) % 3001).alias("k"))
    got = rank_in_groups(df, ["g"], ["k"], num_partitions=7)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert sorted(map(tuple, got.select("g", "k", "rank").collect())) == \
        sorted(map(tuple, want.select("g", "k", "rank").collect()))


def _articles(spark, n, item="i"):
    return spark.createDataFrame(
        [(0, "drug", item, f"{p:03d}", "t", "PubMed", "u", False, "") for p in range(n)],
        "query_id long, item_type string, item_id string, pmid string, title string, db_name string, "
        "url string, has_pdf boolean, pdf_url string")


def test_trim_rounds_nine_two_zero(spark):
    arts = _articles(spark, 9)
    items = spark.createDataFrame([(0, "drug", "i", "n")], "query_id long, item_type string, item_id string, name string")
    size = trim_to_budget(arts, items, budget_bytes=10 ** 9).count()
    assert size == 9
    # per article bytes are equal; allow the shell plus a bit more than 2 articles
    one = trim_to_budget(arts, items, budget_bytes=10 ** 9).select(
        F.octet_length(F.to_json(F.struct("pmid", "title", "db_name", "url", "has_pdf", "pdf_url")))).first()[0] + 11
    shell = len('{"n": {"item_pmids": []}}')
    budget = shell + 2 * one + 2
    kept = trim_to_budget(arts, items, budget_bytes=budget)
    assert kept.count() == 2 and kept.first().trim_round == 1
    nothing = trim_to_budget(arts, items, budget_bytes=shell + 1)
    assert nothing.count() == 0


def test_trim_never_fits_flags_over_budget(spark):
    arts = _articles(spark, 5)
    items = spark.createDataFrame([(0, "drug", "i", "n")], "query_id long, item_type string, item_id string, name string")
    from litrank.operators import budget as B
    kept = B.trim_to_budget(arts, items, budget_bytes=10)
    assert kept.count() == 0
    kept, rounds = B.trim_to_budget(arts, items, budget_bytes=10, with_rounds=True)
    assert kept.count() == 0 and rounds.first().over_budget is True
    one = B.trim_to_budget(_articles(spark, 1), items, budget_bytes=10 ** 9)
    assert one.first().over_budget is False


def test_default_rules_are_the_reference_rule(spark):
    items = _items(spark, [(1, "drug", "d1", "Favipiravir", 0.1, 0.2), (1, "drug", "d2", "Aspirin", 0.1, 0.2),
                           (2, "drug", "d1", "Favipiravir", 0.1, 0.2)])
    q = spark.createDataFrame([(1, "SARS-CoV-2 outcomes"), (2, "influenza")], "query_id long, query string")
    got = {(r.query_id, r.item_id): r.ranking_score for r in R.apply_overrides(items, q).collect()}
    assert got == {(1, "d1"): 1.0, (1, "d2"): 0.2, (2, "d1"): 0.2}


def test_hot_group_is_spread_over_partitions(spark):
    """The skew property rank_in_groups relies on: a group holding most rows
    is cut into several range partitions, and its ranks stay exact."""
    from pyspark.sql import Window
    rows = [("hot", f"{i:05d}") for i in range(2000)] + [(f"g{i}", "00001") for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k string")
    parts = (df.repartitionByRange(8, "g", "k").withColumn("p", F.spark_partition_id())
               .where(F.col("g") == "hot").select("p").distinct().count())
    assert parts >= 6
    got = rank_in_groups(df, ["g"], ["k"], num_partitions=8)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert sorted(map(tuple, got.select("g", "k", "rank").collect())) == \
        sorted(map(tuple, want.select("g", "k", "rank").collect()))


def test_quantile_of_hot_groups_equals_percentile(spark):
    """A group with most rows, many ties, few values, only nulls, one row: as ``percentile`` has them."""
    from litrank.operators.quantile import group_quantiles, spread_quantile
    rng = random.Random(6)
    rows = [(1, rng.random()) for _ in range(4000)] + [(1, 0.5)] * 3000 + [(2, float(i % 3)) for i in range(100)]
    rows += [(3, None), (3, None), (4, 7.0), (5, 1.0), (5, None), (5, 2.0), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.9, 0.5, 0.0, 1.0, 0.123):
        want = df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect()
        for n in (1, 7):
            assert sorted(map(str, spread_quantile(df, ["g"], "v", q, "p", n).collect())) == sorted(map(str, want))
    assert spread_quantile(df.where("false"), ["g"], "v", 0.9, "p").collect() == []
    two = {"p": ("v", 0.9), "m": ("v", 0.5)}
    ways = [sorted(map(str, group_quantiles(df, ["g"], two, most).select("g", "p", "m").collect())) for most in (10, 10 ** 6)]
    assert ways[0] == ways[1] and len(ways[0]) == 6


def test_quantile_spreads_a_hot_group(spark):
    """Neither the counts nor the values summed up one by one meet in one task."""
    from litrank.operators.quantile import spread_quantile
    df = spark.range(0, 20000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    assert spread_quantile(df, ["g"], "v", 0.9, "p", 8).first().p == df.agg(F.percentile("v", 0.9)).first()[0]
    parts = df.groupBy("g", "v").count().repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count()
    assert parts.count() == 8 and parts.agg(F.max("count")).first()[0] < 5000


def test_top_k_keeps_k_rows_in_each_map_task(spark):
    items = _items(spark, [(i % 2, "drug", f"i{i:03d}", "n", 0.0, float(i % 7)) for i in range(100)])
    got = R.top_k_by_score(items, 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r["rank"], r.item_id) for r in got.collect())[:3] == [(0, 1, "i006"), (0, 2, "i020"), (0, 3, "i034")]


def test_unfiltered_queries_pass_by_window_and_quantile(spark):
    items = _items(spark, [(q, "drug", f"i{i:03d}", "n", i / 100, float(i)) for q in (1, 2) for i in range(100)]) \
        .withColumn("do_filter", F.col("query_id") == 1)
    got = R.rank_items(items, 5, "do_filter").collect()
    assert sorted(r.item_id for r in got if r.query_id == 1) == ["i095", "i096", "i097", "i098", "i099"]
    passed = [r for r in got if r.query_id == 2]
    assert len(passed) == 100 and all(r.p90 is None and r["rank"] is None for r in passed)


def test_many_rules_of_one_name(spark):
    items = _items(spark, [(1, "drug", "d1", "n", 0.1, 0.2), (1, "drug", "d2", "m", 0.1, None), (2, "drug", "d1", "n", 0.1, 0.2)])
    rules = spark.createDataFrame([(f"t{i}", "n", i / 1000) for i in range(2000)] + [("t5", "n", 3.0), ("T5", "n", 3.0)],
                                  "trigger string, item_name string, score double")
    q = spark.createDataFrame([(1, "about T5"), (2, "none")], "query_id long, query string")
    got = {(r.query_id, r.item_id): r.ranking_score for r in R.apply_overrides(items, q, rules).collect()}
    assert got == {(1, "d1"): 3.0, (1, "d2"): None, (2, "d1"): 0.2}
