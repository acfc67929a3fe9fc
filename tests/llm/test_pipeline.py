"""The pipeline, stage by stage, on odd documents and on the small driver tables."""

import os
import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from litrank.llm import language_mixture
from litrank.llm.queries import ORACLES, QUERIES
from litrank.session import scratch_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, odd_docs):
    """What each stage keeps of the odd documents."""
    out, docs = {}, odd_docs
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, None).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def first_copies(rows):
    """Of equal texts the longest, then the smallest id (null ids last), as plain Python."""
    best = {}
    for r in rows:
        key = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        if bare(r.text) not in best or key < best[bare(r.text)][0]:
            best[bare(r.text)] = (key, r)
    return [r for _, r in best.values()]


def without_near_copies(rows, n=5, percent=80):
    """Of each component of texts with similar n-word shingles the row with the smallest id (a null id stays
    only where its component has no other), as plain Python."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def test_stages(kept, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(kept[n].columns == odd_docs.columns for n in ("language", "exact_dedup", "near_dedup", "pii"))
    ids = lambda rows: sorted(str(r.doc_id) for r in rows)
    language = [r for r in odd_docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert ids(kept["language"].collect()) == ids(language)
    exact = first_copies(language)
    assert ids(kept["exact_dedup"].collect()) == ids(exact)
    assert {"100", "101", "102", "103"} <= set(ids(exact)) and not {"0", "1", "2", "3"} & set(ids(exact))
    near = without_near_copies(exact)
    assert ids(kept["near_dedup"].collect()) == ids(near)
    assert {"101", "4", "303", "304", "308", "400", "None"} <= set(ids(near)) and len(near) < len(exact) - 40
    rows = kept["pii"].collect()
    assert all(r.n_chars == len(r.text) for r in rows) and ids(rows) == ids(near)
    assert {r.doc_id for r in kept["packing"].collect()} == {r.doc_id for r in near}


def test_stages_on_an_empty_table(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == \
        sorted(map(str, want.project(", ".join(cols)).fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_dedup_drops_by_id_and_text(spark):
    words = [f"w{k}" for k in range(60)]
    base, other, third = (" ".join(f"{c}{w}" for w in words) for c in "abc")
    rows = [(1, base), (None, base + " end"), (None, other), (None, None),       # a near copy beside clean rows
            (2, base + " more"), (2, third)]                                     # one id, one text a near copy
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert kept.columns == docs.columns
    want = [(1, base), (None, other), (None, None), (2, third)]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, want))


def test_language_stage_follows_the_prediction(spark, odd_docs, monkeypatch):
    real = language_mixture.predict
    want = sorted(str(r.doc_id) for r in odd_docs.where("doc_id <> 3 OR doc_id IS NULL").collect()
                  if any(c.isalpha() for c in r.text or ""))
    monkeypatch.setattr(language_mixture, "predict", lambda docs, model: real(docs, model).withColumn(
        "lang_pred", F.when(F.col("doc_id") == 3, "und").otherwise(F.col("lang_pred"))))
    kept = corpus_pipeline.language(spark, odd_docs, None)
    assert kept.columns == odd_docs.columns and {r.score for r in kept.collect()} == {"x"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
