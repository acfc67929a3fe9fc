"""Randomised checks against plain-Python models of the reference's behaviour."""
import json
import random
import re

from pyspark.sql import functions as F

from litrank.constants import QUERY_PUNCTUATION
from litrank.functions import text as TX
from litrank.functions.json_size import float_length
from litrank.operators.budget import METRICS, trim_to_budget
from litrank.operators.containment import link_items, match_batch

ALPHABET = ["a", "b", "c", "A", "é", "-", "(", ")", ".", ",", " ", "  ", "\n", "\t", " ", "　",
            "\x1c", "_", "'", "ab", "ba", "the"]


def py_normalize(q):
    q = q.lower().translate(str.maketrans(QUERY_PUNCTUATION, " " * len(QUERY_PUNCTUATION))).strip()
    return re.sub("[ ]+", " ", q)


def py_tokens(q):
    return py_normalize(q).split()


def rand_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_normalize_and_tokenize_match_python(spark):
    rng = random.Random(7)
    texts = [rand_text(rng, rng.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.k) for r in df.select("i", TX.normalize_query("t").alias("n"),
                                               TX.tokenize("t").alias("k")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (py_normalize(t), py_tokens(t)), repr(t)


def test_match_batch_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["x", "y", "z", "xy", "the", "(z)", "x-y"]
    arts = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))),
             " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    queries = [(j, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for j in range(12)]
    a = spark.createDataFrame(arts, "doi string, title string, abstract string")
    q = spark.createDataFrame(queries, "query_id int, query string")
    got = sorted((r.query_id, r.doi) for r in match_batch(a, q).collect())
    want = sorted((j, d) for j, qq in queries for d, t, ab in arts
                  if any(all(k in py_tokens(f) for k in py_tokens(qq)) for f in (t, d, ab)))
    assert got == want


def test_link_items_phrase_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["red", "blue", "widget", "bolt", "the"]
    arts = [(str(i), None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "X") for i in range(50)]
    names = [("I%d" % k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), "drug") for k in range(15)]
    a = spark.createDataFrame(arts, "doi string, title string, abstract string, db_name string")
    it = spark.createDataFrame(names, "item_id string, name string, item_type string")
    links, _ = link_items(a, it, phrase=True)
    got = sorted((r.item_id, r.pmid) for r in links.collect())
    want = sorted({(k, d) for k, n, _ in names for d, _, ab, _ in arts
                   if (" " + " ".join(py_tokens(n)) + " ") in (" " + " ".join(py_tokens(ab)) + " ")})
    assert got == want


def test_float_length_is_that_of_repr(spark):
    rng = random.Random(9)
    xs = [0.0, -0.0, 1.0, -1.0, 0.5, 1e-4, 9.999e-5, 1e16, 9999999999999998.0, 1e15, 123456789.0, 2.0 ** -44, 1 / 3, 2 / 3, 1e22,
          1e23, 5e-5, 0.1 + 0.2, 1e100, 1.5e-300, float("inf"), float("-inf"), float("nan"), 2.0 ** 60, 1e7, 0.001, 100.0]
    xs += [rng.randint(1, 999) / rng.randint(1, 9999) for _ in range(3000)]
    xs += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(2000)] + [rng.random() for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", float_length("x").alias("n"))
    wrong = [(xs[r.i], r.n) for r in df.collect() if r.n != len(json.dumps(xs[r.i]))]
    assert not wrong, wrong[:5]


def test_trim_matches_reference_loop(spark):
    """The loop over the whole JSON of the items, lists cut to a quarter until it fits."""
    rng = random.Random(3)
    rows, items = [], []
    for it in range(6):
        n = rng.choice([0, 1, 3, 4, 9, 17, 40, 100])
        items.append((0, "drug", f"i{it}", f'n"a\\mé{it}', n, rng.randint(100, 10 ** 6), rng.random(), rng.random() ** 9,
                      0.0 if it == 2 else rng.random() / 10 ** it, rng.choice([0.0, -0.5, 1 / 3]), rng.choice([1.0, rng.random(), None])))
        for p in range(n):
            rows.append((0, "drug", f"i{it}", f"{rng.randint(0, 999):03d}", "".join(rng.choice('t"\\é日\U0001F600\x7f\n') for _ in range(rng.randint(0, 30))),
                         "PubMed", "u", rng.random() < 0.5, ""))
    schema = ("query_id long, item_type string, item_id string, pmid string, title string, db_name string, "
              "url string, has_pdf boolean, pdf_url string")
    arts = spark.createDataFrame(rows, schema)
    its = spark.createDataFrame(items, "query_id long, item_type string, item_id string, name string, n_hit_item long, "
                                "n_item long, precision double, recall double, f_0_5 double, sentiment double, ranking_score double")

    def size(lists):
        out = {}
        for i in items:
            entry = {"pmid": 3, "title": 4, "db_name": 5, "url": 6, "has_pdf": 7, "pdf_url": 8}
            out[i[3]] = {"counter": i[4], "item_pmids": [{k: a[p] for k, p in entry.items()} for a in lists[i[2]]],
                         "metrics": dict(zip(METRICS, i[4:]))}
        return len(json.dumps(out))

    whole = {i[2]: sorted([r for r in rows if r[2] == i[2]], key=lambda r: r[3]) for i in items}
    cuts = [size({k: v[:len(v) // 4 ** r] for k, v in whole.items()}) for r in range(5)]
    for budget in [b + d for b in cuts for d in (-1, 0, 1)] + [10 ** 7, 20000, 300]:
        lists, rounds = whole, 0
        while size(lists) > budget and any(lists.values()):      # the reference's loop
            lists = {k: v[: len(v) // 4] for k, v in lists.items()}
            rounds += 1
        want = sorted((r[2], r[3]) for v in lists.values() for r in v)
        kept, ends = trim_to_budget(arts, its, budget_bytes=budget, with_rounds=True)
        assert sorted((r.item_id, r.pmid) for r in kept.collect()) == want, budget
        assert (ends.first().trim_round, ends.first().over_budget) == (rounds, size(lists) > budget), budget
