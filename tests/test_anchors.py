"""The anchor join (T5, J8) against brute force, on all its paths, and the number of rows it joins."""
import os
import random

import pytest

from litrank import fixtures
from litrank.functions import text as TX
from litrank.operators import containment as C

SMALL = "/root/testdata/sf0.01"


def tokens(text):
    spaced = (text or "").lower().translate(str.maketrans(TX.QUERY_PUNCTUATION, " " * len(TX.QUERY_PUNCTUATION)))
    return spaced.split()


@pytest.fixture(scope="module")
def tables(spark):
    """A third of all field tokens is "the"; ids repeat with other texts; names repeat, overlap or are blank."""
    rng = random.Random(2)
    words = ["the"] * 4 + ["red", "blue", "widget", "bolt", "é", "x-y", "rare"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    arts = [(str(i % 70), None if i % 9 == 0 else text(rng.randint(0, 4)), text(rng.randint(0, 12)), f"db{i % 2}")
            for i in range(90)] + [(None, "red", "the red", "db0")]
    names = [(f"I{k % 20}", text(rng.randint(1, 3)), "drug") for k in range(25)]
    names += [("I50", " ,. ", "drug"), ("I51", None, "drug"), ("I52", "absent word", "target"), ("I53", "the", "drug"),
              ("I53", "the", "drug")]
    return (arts, names, spark.createDataFrame(arts, "doi string, title string, abstract string, db_name string"),
            spark.createDataFrame(names, "item_id string, name string, item_type string"))


def brute(arts, names, phrase):
    run = lambda t: " " + " ".join(t) + " "
    holds = (lambda f, n: run(tokens(n)) in run(tokens(f))) if phrase else (lambda f, n: set(tokens(n)) <= set(tokens(f)))
    return sorted({(d, db, k, ty) for k, n, ty in names if tokens(n) for d, t, a, db in arts
                   if d is not None and any(holds(f, n) for f in (t, d, a))})


@pytest.mark.parametrize("phrase", [False, True])
@pytest.mark.parametrize("path", ["few anchors", "many anchors", "no broadcast"])
def test_links_equal_brute_force(tables, monkeypatch, phrase, path):
    arts, names, a, it = tables
    if path == "many anchors":
        monkeypatch.setattr(C, "FEW_ANCHORS", 2)
    links, empty = C.link_items(a, it, phrase=phrase, max_broadcast_rows=0 if path == "no broadcast" else 1000)
    want = brute(arts, names, phrase)
    assert sorted(map(tuple, links.collect())) == want
    assert {r.item_id for r in empty.collect()} == {n[0] for n in names} - {w[2] for w in want} >= {"I50", "I51", "I52"}


def test_match_with_counts_and_several_keywords(spark, tables):
    arts, _, a, _ = tables
    asked = [(1, ["the red", "widget"]), (2, ["rare"]), (3, [" "]), (4, []), (5, None), (6, ["absent"]), (7, [None, "bolt"])]
    q = spark.createDataFrame(asked, "query_id int, words array<string>")
    want = sorted({(k, d) for k, kws in asked if kws for d, t, ab, _ in arts
                   if d is not None and any({x for w in kws for x in tokens(w)} <= set(tokens(f)) for f in (t, d, ab))})
    need = C.wanted_tokens(q, ["query_id"], "words").selectExpr("explode(need) token").distinct()
    counts = C.token_counts(a, C.DEFAULT_FIELDS, need)
    for extra in ({}, {"counts": counts}, {"max_broadcast_rows": 0}, {"counts": counts, "max_broadcast_rows": 0}):
        got = C.match_batch(a, q, keywords_col="words", **extra).collect()
        assert sorted(map(tuple, got)) == want


def test_counts_are_the_same_with_and_without_broadcast(spark, tables):
    arts, _, a, _ = tables
    some = spark.createDataFrame([("the",), ("rare",), ("absent",)], "token string")
    flat = [x for d, t, ab, _ in arts for f in (t, d, ab) for x in tokens(f)]
    want = {"the": flat.count("the"), "rare": flat.count("rare")}
    for rows in (100, 0):
        assert {r.token: r.n for r in C.token_counts(a, C.DEFAULT_FIELDS, some, rows).collect()} == want


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver tables")
@pytest.mark.parametrize("phrase", [False, True])
def test_joined_rows_are_about_the_links(spark, phrase):
    fx = fixtures.load(spark, SMALL)
    arts, items = fx["articles"], fx["dictionary"]
    anchors = C.item_anchors(arts, items, C.DEFAULT_FIELDS, phrase)
    joined = C.anchor_candidates(arts, anchors, "doi", ["item_id", "item_type"], C.DEFAULT_FIELDS).count()
    links = C.link_items(arts, items, phrase=phrase)[0].count()
    assert 0 < links <= joined <= 4 * links and joined < arts.count() * items.count() / 100
