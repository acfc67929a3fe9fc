"""Joins, predicates, sources, sinks and output hand cases."""
import json

from pyspark.sql import functions as F

from litrank.operators import links as L
from litrank.operators import predicates as P
from litrank.operators.containment import link_items
from litrank.plans.output import to_item_json, to_result_json
from litrank.sinks import writers as W
from litrank.sources import readers as RD


def titles(spark, rows):
    return spark.createDataFrame(rows, "pmid string, db_name string, url string, title string, pmcid string")


def test_article_info_defaults_and_urls(spark):
    t = titles(spark, [("1", "PubMed", None, "T1", "PMC9"), ("2", "Crossref", None, None, "NULL"),
                       ("3", "Xrxiv", "http://x", "T3", None)])
    links = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "pmid string")
    got = {r.pmid: tuple(r)[1:] for r in L.attach_article_info(links, t).collect()}
    assert got["1"] == ("T1", "PubMed", "https://pubmed.ncbi.nlm.nih.gov/1/", True,
                        "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9/pdf")
    assert got["2"] == (None, "Crossref", "https://www.doi.org/2", False, "")
    assert got["3"] == ("T3", "Xrxiv", "http://x", False, "")
    assert got["4"] == ("", "", "", False, "")


def test_missing_info_null_aware(spark):
    links = spark.createDataFrame([("1", "PubMed"), ("2", "PubMed"), ("2", "PubMed")], "pmid string, db_name string")
    t = titles(spark, [("1", "PubMed", None, "a", None)])
    assert L.articles_missing_info(links, t).count() == 2
    assert L.articles_missing_info(links, t, distinct=True).count() == 1
    with_null = titles(spark, [("1", "PubMed", None, "a", None), (None, "PubMed", None, "b", None)])
    assert L.articles_missing_info(links, with_null).count() == 2
    assert L.articles_missing_info(links, with_null, null_aware=True).count() == 0


def _rows_by_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_missing_info_moves_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """Narrow rows compress so well that AQE would merge all of them into one task."""
    monkeypatch.setattr(L, "MAX_BROADCAST_HITS", 10)
    links = spark.range(1_200_000).select((F.col("id") % 400_000).cast("string").alias("pmid"), F.lit("PubMed").alias("db_name")) \
        .unionByName(spark.createDataFrame([(None, "PubMed")], "pmid string, db_name string"))
    t = spark.range(0, 400_000, 4).select(F.col("id").cast("string").alias("pmid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.articles_missing_info(links, t)
        per_task = _rows_by_task(got)
        assert sum(per_task) == 900_001 and len(per_task) == 3 and per_task[-1] < 500_000
        assert got.where("pmid is null").count() == 1 and got.where("pmid % 4 = 0").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_of_many_hits_move_to_as_many_tasks_as_they_need(spark):
    """Two queries with the same articles: the links of an article count for each of them."""
    links = [(str(i % 300), f"D{i % 7}", "drug") for i in range(3000)] + [(None, "D1", "drug")]
    hits = [(q, str(p)) for q in (1, 2) for p in range(0, 300, 2)] + [(1, None)]
    lk = spark.createDataFrame(links, "pmid string, item_id string, item_type string")
    h = spark.createDataFrame(hits, "query_id long, pmid string")
    got = L.restrict_links(lk, h, max_broadcast_hits=0, rows_in_task=100)
    per_task = _rows_by_task(got)
    assert len(per_task) > 40 and per_task[-1] <= 300
    want = sorted((q, p, i, k) for q, p in hits for lp, i, k in links if p is not None and p == lp)
    cols = ["query_id", "pmid", "item_id", "item_type"]
    assert sorted(map(tuple, got.select(cols).collect())) == want
    assert sorted(map(tuple, L.restrict_links(lk, h).select(cols).collect())) == want


def test_drop_unusable_links_null_type(spark):
    cat = spark.createDataFrame([("d1", "a", "SmallMoleculeDrug", "solid"), ("d2", "b", None, "solid"),
                                 ("d3", "c", "SmallMoleculeDrug", "liquid")],
                                "drugbank_id string, name string, type string, state string")
    links = spark.createDataFrame([("p", "d1"), ("p", "d2"), ("p", "d3"), ("p", "t9")], "pmid string, item_id string")
    assert sorted(r.item_id for r in P.drop_unusable_links(links, cat).collect()) == ["d1", "t9"]


def test_upsert_last_wins_and_idempotent(spark):
    base = titles(spark, [("1", "PubMed", None, "old", None), ("2", "PubMed", None, "keep", None)])
    new = spark.createDataFrame([("1", "PubMed", None, "first", None, 1), ("1", "PubMed", None, "second", None, 2),
                                 ("3", "Xrxiv", None, "new", None, 1)],
                                "pmid string, db_name string, url string, title string, pmcid string, seq int")
    once = W.upsert_titles(base, new, order_col="seq")
    got = {r.pmid: r.title for r in once.collect()}
    assert got == {"1": "second", "2": "keep", "3": "new"}
    twice = W.upsert_titles(once, new, order_col="seq")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_append_links_modes(spark):
    base = spark.createDataFrame([("1", "X", "d", "drug"), ("1", "X", "d", "drug")],
                                 "pmid string, db_name string, item_id string, item_type string")
    new = spark.createDataFrame([("1", "X", "d", "drug"), ("2", "X", "d", "drug"), ("2", "X", "d", "drug")],
                                "pmid string, db_name string, item_id string, item_type string")
    assert W.append_links(base, new).count() == 5
    once = W.append_links(base, new, "distinct")
    assert once.count() == 3
    assert W.append_links(once, new, "distinct").count() == 3   # second run links nothing new


def test_link_items_brute_force_and_phrase(spark):
    docs = ["the red widget is here", "widget red", "a blue  bolt, and more", "nothing", "red. widget!"]
    arts = spark.createDataFrame([(str(i), None, d, "Xrxiv") for i, d in enumerate(docs)],
                                 "doi string, title string, abstract string, db_name string")
    items = spark.createDataFrame([("B1", "Red Widget", "drug"), ("B2", "blue bolt", "drug"),
                                   ("B3", "   ", "drug"), ("B4", "zzz", "drug")],
                                  "item_id string, name string, item_type string")
    links, empty = link_items(arts, items)
    got = sorted((r.item_id, r.pmid) for r in links.collect())
    assert got == [("B1", "0"), ("B1", "1"), ("B1", "4"), ("B2", "2")]
    assert sorted(r.item_id for r in empty.collect()) == ["B3", "B4"]
    plinks, _ = link_items(arts, items, phrase=True)
    assert sorted((r.item_id, r.pmid) for r in plinks.collect()) == [("B1", "0"), ("B1", "4"), ("B2", "2")]


def test_dumps_dedup_and_corrupt(spark, tmp_path):
    d = tmp_path / "dumps"
    d.mkdir()
    (d / "a.jsonl").write_text('{"doi": "0456", "title": "A", "abstract": "x"}\n{"doi": "7", "title": "B"}\n')
    (d / "b.jsonl").write_text('{"doi": "0456", "title": "Z", "abstract": "y"}\nnot json\n')
    df = RD.read_dumps(spark, str(d))
    bad = df.where(F.col("_corrupt_record").isNotNull()).select("doi", "_corrupt_record").collect()
    assert len(bad) == 1 and bad[0].doi is None
    first = {r.doi: r.title for r in RD.dedup_articles(df.where("_corrupt_record IS NULL")).collect()}
    assert first == {"0456": "A", "7": "B"}      # leading zero kept, first file wins
    last = {r.doi: r.title for r in RD.dedup_articles(df.where("_corrupt_record IS NULL"), keep="last").collect()}
    assert last["0456"] == "Z"


def test_flatten_esummary_and_crossref(spark):
    raw = spark.createDataFrame([(json.dumps({"result": {"uids": ["1", "2"],
                                  "1": {"uid": "1", "title": "T", "articleids": [{"idtype": "pmc", "value": "PMC1"}]},
                                  "2": {"uid": "2", "title": "U", "articleids": [{"idtype": "pmc", "value": "NULL"}]}}}),)],
                                "value string")
    got = sorted(map(tuple, RD.flatten_esummary(raw).collect()))
    assert got == [("1", "T", "PMC1"), ("2", "U", None)]
    cr = spark.createDataFrame([(json.dumps({"message": {"items": [{"DOI": "10/x", "title": [], "URL": "u"}]}}),)],
                               "value string")
    assert [tuple(r) for r in RD.flatten_crossref(cr).collect()] == [("10/x", None, "u")]


def test_result_json_same_name_last_id_and_empty(spark):
    ranked = spark.createDataFrame(
        [(1, "drug", "D1", "Aspirin", 3, 9, 0.3, 0.1, 0.2, 0.0, 0.5, 1),
         (1, "drug", "D2", "Aspirin", 4, 8, 0.5, 0.2, 0.3, 0.0, 0.4, 2)],
        "query_id long, item_type string, item_id string, name string, n_hit_item long, n_item long, "
        "precision double, recall double, f_0_5 double, sentiment double, ranking_score double, rank int")
    q = spark.createDataFrame([(1, "a", True, False), (2, "b", True, False)],
                              "query_id long, query string, do_filter boolean, with_articles boolean")
    out = {r.query_id: json.loads(r.result) for r in to_result_json(ranked, q).collect()}
    assert out[2] == {"drugs": {}, "targets": {}}
    entry = out[1]["drugs"]["Aspirin"]
    assert entry["counter"] == 4 and "item_pmids" not in entry
    assert entry["metrics"]["(Search + {}) Publications"] == 4 and entry["metrics"]["F-0.5"] == 0.3


def test_item_json_is_the_entry_of_the_whole_result(spark):
    ranked = spark.createDataFrame(
        [(1, "drug", "D1", "Aspirin", 3, 9, 0.3, 0.1, 0.2, 0.0, 0.5), (1, "drug", "D2", "Aspirin", 4, 8, 0.5, 0.2, 0.3, 0.0, None),
         (1, "target", "T1", 'a "b"', 1, 2, 0.5, 0.25, 0.4, -0.1, 0.1), (2, "drug", "D1", "Aspirin", 3, 9, 0.3, 0.1, 0.2, 0.0, 0.5)],
        "query_id long, item_type string, item_id string, name string, n_hit_item long, n_item long, "
        "precision double, recall double, f_0_5 double, sentiment double, ranking_score double")
    q = spark.createDataFrame([(1, "a", False, True), (2, "b", True, False), (3, "c", None, False), (4, "d", False, False)],
                              "query_id long, query string, do_filter boolean, with_articles boolean")
    whole = {r.query_id: json.loads(r.result) for r in to_result_json(ranked, q).collect()}
    items = [(r.query_id, r.item_type, r.name, json.loads(r.result)) for r in to_item_json(ranked, q).collect()]
    assert len(items) == 2 and {i[0] for i in items} == {1}
    for i, kind, name, entry in items:
        assert whole[i][kind + "s"][name] == entry
    assert to_item_json(ranked.where("false"), q).count() == 0


def test_article_lists_of_a_batch_beyond_the_broadcast_bound(spark, monkeypatch):
    from litrank.plans import output as O
    links = spark.createDataFrame([(str(i % 9), f"D{i % 2}", "drug") for i in range(30)], "pmid string, item_id string, item_type string")
    hits = spark.createDataFrame([(1, str(i)) for i in range(0, 9, 2)], "query_id long, pmid string")
    t = titles(spark, [(str(i), "PubMed", None, f"T{i}", None) for i in range(8)] + [(None, "PubMed", None, "none", None)])
    ranked = spark.createDataFrame([(1, "drug", f"D{i}", f"n{i}", 5, 9, 0.5, 0.5, 0.5, 0.5, 0.5) for i in range(2)],
                                   "query_id long, item_type string, item_id string, name string, n_hit_item long, n_item long, "
                                   "precision double, recall double, f_0_5 double, sentiment double, ranking_score double")
    want = sorted(map(str, O.article_lists(ranked, hits, links, t).collect()))
    joined = []

    def attach(rows, meta):
        joined.append(meta._jdf.queryExecution().optimizedPlan().toString())
        return L.attach_article_info(rows, meta)
    monkeypatch.setattr(O, "MAX_BROADCAST_HITS", 0)
    monkeypatch.setattr(O, "attach_article_info", attach)
    lists = O.article_lists(ranked, hits, links, t)
    assert sorted(map(str, lists.collect())) == want and len(want) == 2
    # Q cuts no titles: they move once, by the join with the links
    assert len(joined) == 1 and "LeftSemi" not in joined[0]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    links = spark.createDataFrame([(str(i % 50), f"D{i % 7}", "drug") for i in range(500)],
                                  "pmid string, item_id string, item_type string")
    sents = spark.createDataFrame([(str(i), 0.5 if i % 2 else -0.5) for i in range(50)],
                                  "pmid string, sentiment_score double")
    W.write_bucketed(links, "lr_links_b", buckets=4, path=str(tmp_path / "links"))
    W.write_bucketed(sents, "lr_sents_b", buckets=4, path=str(tmp_path / "sents"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("lr_links_b").join(spark.table("lr_sents_b"), "pmid")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and j.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS lr_links_b")
        spark.sql("DROP TABLE IF EXISTS lr_sents_b")


def test_write_table_clusters_and_never_overwrites(spark, tmp_path):
    import pytest
    df = spark.createDataFrame([(str(i % 7), f"D{i}") for i in range(100)], "pmid string, item_id string")
    path = str(tmp_path / "links_v1")
    W.write_table(df, path, cluster_by=["pmid", "item_id"], sort_within=["pmid"], partitions=4)
    back = RD.scan_table(spark, path)
    assert back.count() == 100
    with pytest.raises(Exception):
        W.write_table(df, path)


def test_corrupt_responses_leave_a_trace(spark):
    rows = [('{"result": {"uids": ["1"], "1": {"title": "a"}}}',), ('{"result": {"1": {"ti',), ("<html>", ), ("{}",), (None,)]
    raw = spark.createDataFrame(rows, "value string")
    assert sorted(map(str, (r.value for r in RD.corrupt_responses(raw).collect()))) == \
        sorted(map(str, (r[0] for r in rows[1:])))
    cr = spark.createDataFrame([('{"message": {"items": [{"DOI": "10/x"}]}}',), ('{"message": {"it',)], "value string")
    assert RD.corrupt_responses(cr, kind="crossref").count() == 1


def test_catalog_columns_by_name(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('extra,name,type,state,drugbank_id\nx,"a ""b"", c",SmallMoleculeDrug,solid,007\n'
                    'x,d,BiotechDrug,solid,2\n')
    assert [tuple(r) for r in RD.read_catalog(spark, str(path), "drugbank_id", "drug").collect()] == \
        [("007", 'a "b", c', "drug")]
    path.write_text("name,drugbank_id\nd,2\n")
    assert [tuple(r) for r in RD.read_catalog(spark, str(path), "drugbank_id", "drug").collect()] == [("2", "d", "drug")]


def test_match_keywords_with_alternatives(spark):
    from litrank.operators.containment import match_keywords
    a = spark.createDataFrame([("1", "red fox", None), ("2", "red cat", None), ("3", "blue cat", None)],
                              "doi string, title string, abstract string")
    ids = lambda *k: sorted(r.doi for r in match_keywords(a, list(k)).collect())
    assert ids("red", ["fox", "cat"]) == ["1", "2"] and ids(["fox", "blue"]) == ["1", "3"]


def test_repeated_ids_are_one_article(spark):
    from litrank.plans.ranking import query_hits
    a = spark.createDataFrame([("1", "the of"), ("1", "the of"), ("2", "the"), ("2", "of")], "doi string, title string")
    q = spark.createDataFrame([(7, "the of")], "query_id bigint, query string")
    assert [tuple(r) for r in query_hits(a, q, fields=("title",)).collect()] == [(7, "1")]
