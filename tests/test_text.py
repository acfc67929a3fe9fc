"""Hand cases for the text operators (FIXTURES.md section 3, SURVEY 2.6.1)."""
from pyspark.sql import functions as F

from litrank.functions import text as TX
from litrank.operators.containment import match_batch, match_keywords


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_normalize_query(spark):
    assert one(spark, TX.normalize_query, " SARS-CoV-2, (COVID) a.b [x\\y] ") == "sars-cov-2 (covid) a b x y"
    # other whitespace inside is kept, space runs collapse, edges are stripped
    assert one(spark, TX.normalize_query, "  a  \n b\t") == "a \n b"


def test_tokenize(spark):
    assert one(spark, TX.tokenize, "") == []
    assert one(spark, TX.tokenize, None) == []
    assert one(spark, TX.tokenize, "A b　C-d (e)") == ["a", "b", "c-d", "(e)"]
    # tokens equal Python's str.split() after the reference's normalisation
    import re
    punct = TX.QUERY_PUNCTUATION
    text = "x\x1cy z,,w  v\x85u"
    py = re.sub("[ ]+", " ", text.lower().translate(str.maketrans(punct, " " * len(punct))).strip()).split()
    assert one(spark, TX.tokenize, text) == py


def test_match_all_tokens(spark):
    df = spark.createDataFrame([(["a", "b"], []), (["a"], ["a", "b"]), (["a", "b"], ["b"])],
                               "f array<string>, k array<string>")
    got = [r[0] for r in df.select(TX.match_all_tokens("f", "k")).collect()]
    assert got == [True, False, True]


def test_match_keywords_and_inside_one_field(spark):
    arts = spark.createDataFrame([("1", "a", "b"), ("2", "a b", "")], "doi string, title string, abstract string")
    assert [r.doi for r in match_keywords(arts, ["a", "b"]).collect()] == ["2"]


def test_match_whole_tokens_only(spark):
    arts = spark.createDataFrame([("1", "covid-19 (covid)", None)], "doi string, title string, abstract string")
    assert match_keywords(arts, ["covid"]).count() == 0


def test_empty_keyword_matches_every_article(spark):
    arts = spark.createDataFrame([("1", "x", None), ("2", None, None)], "doi string, title string, abstract string")
    q = spark.createDataFrame([(1, ""), (2, "x")], "query_id int, query string")
    got = sorted((r.query_id, r.doi) for r in match_batch(arts, q).collect())
    assert got == [(1, "1"), (1, "2"), (2, "1")]


def test_match_salted_equals_broadcast(spark):
    arts = spark.createDataFrame([(str(i), f"t{i % 3} the of", "x the") for i in range(40)],
                                 "doi string, title string, abstract string")
    q = spark.createDataFrame([(1, "the"), (2, "t1 of"), (3, "")], "query_id int, query string")
    a = sorted(tuple(r) for r in match_batch(arts, q).collect())
    b = sorted(tuple(r) for r in match_batch(arts, q, max_broadcast_rows=0).collect())
    assert a == b and len(a) == 40 + 13 + 40


def test_clean_text(spark):
    cases = {"@bob hello": "hello", "rt @bob hi": "bob hi", "see https://x.y then more": "see",
             "an example": "an exle", "Café, NOW!": "caf   now", None: ""}
    for src, want in cases.items():
        assert one(spark, TX.clean_text, src) == want, src


def test_remove_stopwords_keeps_order_and_repeats(spark):
    got = one(spark, lambda c: TX.remove_stopwords(c, ["the", "a"]), "b the a c b  a")
    assert got == "b c b"


def test_stopword_table_in_place_equals_the_join(spark):
    from litrank.operators.sentiment import clean_frame
    texts = ["the cat and the hat", None, "", "THE the", "x the y  the x", "the cat and the hat"]
    arts = spark.createDataFrame([(str(i % 5), t) for i, t in enumerate(texts)] + [(None, "a the b")],
                                 "doi string, abstract string")
    stop = spark.createDataFrame([("the",), ("and",), (None,), ("the",)], "word string")
    want = sorted(map(str, clean_frame(arts, ["the", "and"]).collect()))
    placed = clean_frame(arts, stop)
    assert sorted(map(str, placed.collect())) == want and len(want) == 7
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert sorted(map(str, clean_frame(arts, stop, max_broadcast_rows=0).collect())) == want
    assert sorted(map(str, clean_frame(arts, stop.where("false")).collect())) == \
        sorted(map(str, clean_frame(arts, None).collect()))


def test_token_index_match_equals_live_match_and_prunes(spark, tmp_path):
    from litrank.operators.containment import build_token_index, match_index
    arts = spark.createDataFrame([(str(i), f"t{i % 5} the", f"body {i % 3} of") for i in range(60)],
                                 "doi string, title string, abstract string")
    q = spark.createDataFrame([(1, "t1 the"), (2, "of"), (3, "")], "query_id int, query string")
    path = build_token_index(arts, str(tmp_path / "idx"), buckets=16)
    idx = spark.read.parquet(path)
    got = match_index(idx, q, buckets=16)
    want = match_batch(arts, q)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_sentiment_salted_path_equals_broadcast(spark):
    from litrank.operators.sentiment import sentiment_lexicon
    arts = spark.createDataFrame([(str(i), ("good " * (i % 4)) + "bad the x") for i in range(30)],
                                 "doi string, abstract string")
    lex = spark.createDataFrame([("good", 0.5), ("bad", -0.25)], "word string, polarity double")
    a = sorted(map(tuple, sentiment_lexicon(arts, lex, ["the"]).collect()))
    b = sorted(map(tuple, sentiment_lexicon(arts, lex, ["the"], max_broadcast_rows=0).collect()))
    assert a == b and len(a) == 30
