"""Versions behind a pointer, counters by deltas, and the cache in the ranking plan."""
import pytest
from pyspark.sql import functions as F

from litrank.operators.aggregates import item_counters
from litrank.operators.links import lookup_popular
from litrank.sinks.versions import CounterTable, LostWriter, StaleCounters, VersionedTable
from litrank.sinks.writers import write_popular


def test_readers_resolve_the_current_version(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (VersionedTable(spark, path) for _ in range(2))
    assert one.current() == (0, {}) and one.read() is None
    assert one.commit(spark.range(3), 0, why="first") == 1
    before = two.read()
    assert two.commit(spark.range(5), 1) == 2
    assert before.count() == 3 and one.read().count() == 5 and one.current()[0] == 2
    one.drop_before(2)
    assert one.read().count() == 5 and len(list((tmp_path / "t").glob("version=*"))) == 1


def test_a_lost_writer_is_told_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (VersionedTable(spark, path) for _ in range(2))
    one.commit(spark.range(1), 0)
    start = two.current()[0]
    one.commit(spark.range(2), 1)
    with pytest.raises(LostWriter):
        two.commit(spark.range(9), start)
    assert two.read().count() == 2 and len(list((tmp_path / "t").glob("version=*"))) == 2
    two.commit(spark.range(9), two.current()[0])             # it starts again from the winner
    assert one.read().count() == 9


def test_a_dead_writer_is_never_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path)
    table.commit(spark.range(4), 0)
    spark.range(7).write.parquet(f"{path}/version=2-dead")   # data, but no pointer
    assert table.read().count() == 4
    (tmp_path / "t" / "_versions" / "000000000002").write_text('{"folder": "')   # a pointer cut short
    assert table.current()[0] == 1 and table.read().count() == 4


def test_counters_follow_the_links(spark, tmp_path):
    rows = [(str(p), f"D{p % 3}", "drug") for p in range(20)] + [(None, "D0", "drug"), ("x", "T", "target"), ("y", "D9", "zzz")]
    links = spark.createDataFrame(rows, "pmid string, item_id string, item_type string").withColumn("b", F.col("pmid").try_cast("int") % 2)
    parts = [links.where("b = 0"), links.where("b = 1"), links.where("b IS NULL")]
    table = CounterTable(spark, str(tmp_path / "c"))
    for number, part in enumerate(parts, 1):
        table.add_batch(part, number)
        table.add_batch(part, number)                        # a retried batch
    want = sorted(map(tuple, item_counters(links).collect()))
    assert sorted(map(tuple, table.at(3).select("item_id", "item_type", "counter").collect())) == want
    with pytest.raises(StaleCounters):
        table.at(4)
    with pytest.raises(StaleCounters):
        table.add_batch(parts[0], 5)
    other = CounterTable(spark, str(tmp_path / "d"))
    other.rebuild(links, 7)
    assert sorted(map(tuple, other.at(7).collect())) == want


def test_stored_cache_is_pruned_and_replaces_the_corpus(spark, tmp_path):
    from litrank.plans.ranking import query_hits
    cache = spark.createDataFrame([(f"q{i}", str(p)) for i in range(40) for p in range(3)] + [("none", None)],
                                  "query string, pmid string")
    stored = spark.read.parquet(write_popular(cache, str(tmp_path / "cache"), 8))
    q = spark.createDataFrame([(1, "Q5"), (2, " q7, "), (3, "none"), (4, "other")], "query_id long, query string")
    hits, misses = lookup_popular(q, stored, 8)
    assert sorted(map(tuple, hits.collect())) == [(k, str(p)) for k in (1, 2) for p in range(3)]
    assert [r.query_id for r in misses.collect()] == [4]
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString().lower()
    corpus_path = str(tmp_path / "corpus")
    spark.createDataFrame([("9", "other")], "doi string, title string").write.parquet(corpus_path)
    corpus = spark.read.parquet(corpus_path)
    full = query_hits(corpus, q.where("query_id <= 3"), fields=["title"], cache=stored, cache_buckets=8)
    assert not [f for f in full.inputFiles() if "corpus" in f]
    mixed = query_hits(corpus, q, fields=["title"], cache=stored, cache_buckets=8)
    assert sorted(map(tuple, mixed.collect())) == sorted([(k, str(p)) for k in (1, 2) for p in range(3)] + [(4, "9")])


def test_links_stored_by_bucket_do_not_move(spark):
    import os
    small = "/root/testdata/sf0.001"
    if not os.path.exists(small):
        pytest.skip("needs the driver tables")
    from litrank.driver_queries import QUERIES
    plan = QUERIES["j1_bucketed_links"](spark, small)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    first = text[text.index("Initial Plan"):]
    assert "SortMergeJoin" in first and first.count("Exchange hashpartitioning(pmid") <= 1 and "Bucketed: true" in first
