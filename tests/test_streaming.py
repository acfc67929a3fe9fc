"""The dump stream scores files as they arrive; the result equals the batch job."""
import json

from pyspark.sql import functions as F

from litrank.operators.sentiment import sentiment_lexicon
from litrank.streaming.dump_stream import current_scores, start_scoring


def _write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_stream_scores_new_files(spark, tmp_path):
    dumps, log, ck = tmp_path / "dumps", str(tmp_path / "log"), str(tmp_path / "ck")
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, polarity double")
    _write(dumps, "d1.jsonl", [{"doi": "1", "title": "t", "abstract": "good good bad"},
                               {"doi": "2", "title": "t", "abstract": "nothing here"}])
    q = start_scoring(spark, str(dumps), log, ck, lex, ["here"])
    q.awaitTermination()
    first = {r.pmid: r.sentiment_score for r in current_scores(spark, log).collect()}
    assert first["2"] == 0.0 and abs(first["1"] - 1 / 3) < 1e-12
    # a later file rescoring doi 1 wins; an unchanged doi keeps its score
    _write(dumps, "d2.jsonl", [{"doi": "1", "title": "t", "abstract": "bad"}])
    with open(dumps / "d2.jsonl", "a") as f:
        f.write("not json\n")
    q = start_scoring(spark, str(dumps), log, ck, lex, ["here"])
    q.awaitTermination()
    now = {r.pmid: r.sentiment_score for r in current_scores(spark, log).collect()}
    assert now == {"1": -1.0, "2": 0.0}
    # equal to the batch job over the deduplicated corpus
    arts = spark.createDataFrame([("1", "bad"), ("2", "nothing here")], "doi string, abstract string")
    batch = {r.doi: r.sentiment_score for r in sentiment_lexicon(arts, lex, ["here"]).collect()}
    assert batch == now


def test_stream_links_new_files(spark, tmp_path):
    from litrank.operators.containment import link_items
    from litrank.streaming.dump_stream import start_linking
    dumps, log, ck = tmp_path / "dumps", str(tmp_path / "links"), str(tmp_path / "ck")
    items = spark.createDataFrame([("B1", "red widget", "drug"), ("B2", "bolt", "drug")],
                                  "item_id string, name string, item_type string")
    _write(dumps, "a.jsonl", [{"doi": "1", "title": "A red widget", "abstract": "x"},
                              {"doi": "2", "title": "t", "abstract": "a bolt"}])
    start_linking(spark, str(dumps), items, log, ck, "Xrxiv").awaitTermination()
    _write(dumps, "b.jsonl", [{"doi": "3", "title": "widget red bolt", "abstract": ""}])
    start_linking(spark, str(dumps), items, log, ck, "Xrxiv").awaitTermination()
    got = sorted((r.pmid, r.item_id) for r in spark.read.parquet(log).collect())
    arts = spark.createDataFrame([("1", "A red widget", "x", "Xrxiv"), ("2", "t", "a bolt", "Xrxiv"),
                                  ("3", "widget red bolt", "", "Xrxiv")],
                                 "doi string, title string, abstract string, db_name string")
    want = sorted((r.pmid, r.item_id) for r in link_items(arts, items)[0].collect())
    assert got == want == [("1", "B1"), ("2", "B2"), ("3", "B1"), ("3", "B2")]


def test_an_id_in_two_batches_is_linked_once(spark, tmp_path):
    from litrank.streaming.dump_stream import start_linking
    dumps, log, gone, ck = tmp_path / "dumps", str(tmp_path / "links"), str(tmp_path / "missing"), str(tmp_path / "ck")
    items = spark.createDataFrame([("B1", "widget", "drug"), ("B2", "bolt", "drug")],
                                  "item_id string, name string, item_type string")
    titles = spark.createDataFrame([("3",)], "pmid string")

    def run():
        start_linking(spark, str(dumps), items, log, ck, "Xrxiv", titles=titles, missing_log_dir=gone).awaitTermination()

    _write(dumps, "a.jsonl", [{"doi": "1", "title": "widget", "abstract": "x"}, {"doi": "1", "title": "widget", "abstract": "x"},
                              {"doi": None, "title": "widget", "abstract": "x"}])
    run()
    _write(dumps, "b.jsonl", [{"doi": "1", "title": "widget", "abstract": "bolt"}, {"doi": "2", "title": "bolt", "abstract": ""},
                              {"doi": "3", "title": "bolt", "abstract": ""}])
    run()
    _write(dumps, "c.jsonl", [{"doi": "2", "title": "widget", "abstract": "bolt"}])
    run()
    links = spark.read.parquet(log)
    assert sorted((r.pmid, r.item_id, r.batch_id) for r in links.collect()) == [("1", "B1", 0), ("2", "B2", 1), ("3", "B2", 1)]
    assert sorted(r.pmid for r in spark.read.parquet(gone).collect()) == ["1", "2"]
