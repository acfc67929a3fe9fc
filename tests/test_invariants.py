"""Invariants: a batch equals a loop of single queries; restricting Q to a
superset never lowers TP."""
from pyspark.sql import functions as F

from litrank import fixtures
from litrank.operators.links import item_catalog
from litrank.plans.ranking import rank_queries

SF = "/root/testdata/sf0.001"


def _run(spark, queries):
    fx = fixtures.load(spark, SF)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    return rank_queries(queries, corpus, fx["links"], fx["sentiments"], item_catalog(fx["drugs"], fx["targets"]),
                  rules=fx["rules"], fields=("title", "doi"))


def test_batch_equals_single_queries(spark):
    fx = fixtures.load(spark, SF)
    q = fx["queries"]
    batch = sorted(map(tuple, _run(spark, q).collect()))
    single = []
    for qid in [r.query_id for r in q.select("query_id").collect()]:
        single += [tuple(r) for r in _run(spark, q.where(F.col("query_id") == qid)).collect()]
    assert batch == sorted(single)


def test_ranking_with_token_index_equals_live_match(spark, tmp_path):
    from litrank.operators.containment import build_token_index
    fx = fixtures.load(spark, SF)
    corpus = fx["titles"].select(F.col("pmid").alias("doi"), "title")
    path = build_token_index(corpus, str(tmp_path / "idx"), fields=("title", "doi"), buckets=8)
    from litrank.plans.ranking import query_hits
    live = query_hits(corpus, fx["queries"], fields=("title", "doi"))
    indexed = query_hits(None, fx["queries"], fields=("title", "doi"), index=spark.read.parquet(path),
                         index_buckets=8)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, indexed.collect()))
