"""Exact dedup, n-gram join and embedding graph against brute force."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litrank.llm import embedding_graph, ngram_join, stages
from litrank.llm.digest_index import DigestIndex, keep_first_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_digest_index_marks(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    best = {}
    for i, t in rows:
        key = (-len(t or ""), i is None, i or 0)
        best[plain(t)] = min(best.get(plain(t), key), key)
    sizes = {}
    for _, t in rows:
        sizes[plain(t)] = sizes.get(plain(t), 0) + 1
    want = sorted(((str(i), str(None if best[plain(t)][1] else best[plain(t)][2]), sizes[plain(t)],
                    (-len(t or ""), i is None, i or 0) == best[plain(t)]) for i, t in rows))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in DigestIndex(spark).add(odd_docs).collect())
    assert got == want


def test_digest_index_second_batch(spark, odd_docs, no_docs):
    index = DigestIndex(spark)
    first = index.add(odd_docs, "one")
    n = index.read().count()
    assert n == first.select("digest").distinct().count()
    again = index.add(odd_docs, "one")                    # the same batch again changes nothing
    assert index.read().count() == n
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    more = spark.createDataFrame([(900, "the  only new text"), (901, "word"), (902, "wo rd")], "doc_id bigint, text string")
    marks = {r.doc_id: (r.keep_id, r.kept) for r in index.add(more, "two").collect()}
    assert marks == {900: (900, True), 901: (303, False), 902: (303, False)}
    assert index.add(no_docs, "three").count() == 0


def test_keep_first_copies_once_per_text(spark, odd_docs, no_docs):
    kept = keep_first_copies(odd_docs, stages.stored(DigestIndex(spark).add(odd_docs), "marks"))
    assert kept.columns == odd_docs.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(r.text) for r in odd_docs.collect()})
    assert keep_first_copies(no_docs, stages.stored(DigestIndex(spark).add(no_docs), "marks")).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def brute_links(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    out = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            out[a] += 1
            out[b] += 1
    return sorted((str(i), len(s), k) for (i, _), s, k in zip(rows, sets, out))


@pytest.mark.parametrize("n,percent", [(4, 85), (1, 50)])
def test_numbers_of_links(odd_docs, no_docs, n, percent):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.ngram_jaccard_join(odd_docs, n, percent, count_links=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == brute_links(rows, n, percent)
    assert ngram_join.ngram_jaccard_join(no_docs, n, percent, count_links=True).count() == 0


def test_links_of_a_component_of_many_blocks(spark, monkeypatch):
    """A chain of texts, of which neighbours link: one component, links far fewer than pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k:k + 60 + k % 3])) for k in range(150)]
    rows += [(1000 + k, r[1]) for k, r in enumerate(rows[:70])]              # copies count as links
    rows += [(2000 + k, " ".join(words[:60] + [f"x{k}"])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.ngram_jaccard_join(docs, 4, 85, count_links=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == brute_links(rows, 4, 85)


@pytest.mark.parametrize("pair_cost", [0, 1 << 40])
def test_links_of_a_block_pair_by_pair_and_by_products(pair_cost):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2 ** 62, 80).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[k % 3][rng.integers(0, 12):], rng.integers(0, 2 ** 62, 6).astype(np.uint64)]))
            for k in range(90)]
    table = pa.table({"component": [k % 3 for k in range(90)], "side": [0] * 90, "digest": range(90),
                      "n_shingles": [len(s) for s in sets], "copies": [1 + k % 4 for k in range(90)],
                      "sketch": [ngram_join.parity_sketch(s) for s in sets], "grams": [s.tobytes() for s in sets]})
    want = [0] * 90
    for i, j in combinations(range(90), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            want[i] += 1 + j % 4
            want[j] += 1 + i % 4
    got = ngram_join._count_links(table, 85, pair_cost=pair_cost)
    assert dict(zip(got["digest"].to_pylist(), got["n"].to_pylist())) == {k: n for k, n in enumerate(want) if n}
    assert any(want) and not all(want)


def test_product_is_the_overlap():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 700)).astype(np.uint64)) for _ in range(60)]
    x, y = (np.array(v) for v in zip(*combinations(range(60), 2)))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    assert ngram_join._product(sets, x, y, columns=512).tolist() == want


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join_is_the_full_join(odd_docs, n, percent):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.ngram_jaccard_join(odd_docs, n, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, n, percent)


def test_ngram_join_empty_table(no_docs):
    assert ngram_join.ngram_jaccard_join(no_docs).count() == 0


def test_long_posting_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = " ".join(f"w{k}" for k in range(80)).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i, k in enumerate([*range(0, 80, 2)])]
    rows += [(100 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(40)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.ngram_jaccard_join(docs, 4, 85)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, 4, 85)


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        both = rng.integers(0, 2 ** 63, rng.integers(1, 900)).astype(np.uint64)
        x = np.unique(np.concatenate([both, rng.integers(0, 2 ** 63, rng.integers(0, 300)).astype(np.uint64)]))
        y = np.unique(np.concatenate([both, rng.integers(0, 2 ** 63, rng.integers(0, 300)).astype(np.uint64)]))
        sx, sy = (np.frombuffer(ngram_join.parity_sketch(s), np.uint64) for s in (x, y))
        w = min(len(sx), len(sy))
        bits = np.bitwise_count(ngram_join.fold([sx], w) ^ ngram_join.fold([sy], w)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in stages.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def _graph_case(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((30, 16))
    x = np.concatenate([centre[rng.integers(0, 30, 400)] + 0.12 * rng.standard_normal((400, 16)),
                        rng.standard_normal((300, 16))]).astype(np.float32)
    rows = [(int(i), [float(v) for v in e], int(i) % 2) for i, e in enumerate(x)]
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(50)]                # copies of one vector
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, rows[3][1], None),
             (3004, [], 0), (3005, [1.0, None], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1),
             (3008, [float("inf")] + [1.0] * 15, 1), (5, rows[5][1], rows[5][2]), (None, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int") \
        .withColumns({"n_links": F.lit("x"), "shard": F.lit(1), "weight": F.lit(0.5)})


def _brute_graph(rows, threshold):
    good = [k for k, (_, e, lab) in enumerate(rows) if lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = {k: set() for k in range(len(rows))}
    for a, b in combinations(good, 2):
        x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a].add(b)
            links[b].add(a)
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            todo, comp = [k], set()
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp.add(j)
                    todo += links[j]
            ids = [rows[j][0] for j in comp if rows[j][0] is not None]
            for j in comp:
                seen[j] = min(ids) if ids else None
        out.append((str(rows[k][0]), len(links[k]), str(seen[k]), rows[k][0] is not None and rows[k][0] == seen[k]))
    return sorted(out)


@pytest.mark.parametrize("shard,most", [(1024, 4096), (40, 4096), (60, 50)])
def test_embedding_graph(spark, monkeypatch, shard, most):
    monkeypatch.setattr(embedding_graph, "MOST_NODES", most)
    rows, df = _graph_case(spark)
    want = _brute_graph(rows, 0.98)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept)
                 for r in embedding_graph.near_duplicates(df, shard=shard, recall=1.0, audit=1000).collect())
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(min(a[1], b[1]) for a, b in zip(got, want)) >= 0.99 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert embedding_graph.near_duplicates(df.where("false")).count() == 0


def test_robust_graph_prunes_and_reaches():
    x = np.random.default_rng(4).standard_normal((600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = embedding_graph.robust_graph(x)
    assert max(map(len, near)) <= embedding_graph.DEGREE
    found = set()
    for a, b in embedding_graph.range_walk(x, near, x, 0.8, 32):
        found |= set(zip(a.tolist(), b.tolist()))
    true = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.8))))
    assert found <= true and len(found) >= 0.98 * len(true)


def test_walk_starts_from_the_node_of_a_query_too():
    """A graph of pairs: from a medoid nothing but its own partner can be reached."""
    rng = np.random.default_rng(5)
    one = rng.standard_normal((150, 12))
    x = np.concatenate([one, one + 0.01 * rng.standard_normal((150, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    partner = (np.arange(300) + 150) % 300
    true = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.98))))
    assert len(true) == 600
    found = set()
    for a, b in embedding_graph.range_walk(x, list(partner[:, None]), x, 0.98, 8, own=np.arange(300)):
        found |= set(zip(a.tolist(), b.tolist()))
    assert found == true
    ids, none = np.arange(300) * 7, [None] * 300
    unit = pa.table({"query": [False] * 300 + [True] * 300, "class_id": np.tile(ids, 2), "weight": np.tile(ids % 5 + 1, 2),
                     "embedding": np.tile(x, (2, 1)).tolist(), "near": pa.array(ids[partner][:, None].tolist() + none)})
    got = embedding_graph._walk_shard(unit, 0.98, 8).to_pylist()
    assert {r["class_id"]: r["n_links"] for r in got if r["class_id"] is not None} == \
        {int(i): int(i2 % 5 + 1) for i, i2 in zip(ids, ids[partner])}
    assert {(r["a"], r["b"]) for r in got if r["a"] is not None} == {(int(i) + 1050, int(i)) for i in ids[:150]}


def test_audit_sees_rare_links_beside_a_huge_group(spark):
    """One group has nearly all links; the pairs are cut apart by shards without a margin."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    huge = np.repeat(unit(unit(rng.standard_normal(6)) + 0.001 * rng.standard_normal((2, 6))), 200, axis=0)
    one = unit(rng.standard_normal((150, 6)))
    side = rng.standard_normal((150, 6))
    side = unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    two = np.cos(0.18) * one + np.sin(0.18) * side
    x = np.concatenate([huge, one, two])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    true = ((x @ x.T >= 0.98).sum(axis=1) - 1)
    links = lambda **k: {r.vec_id: r.n_links for r in embedding_graph.near_duplicates(df, shard=12, margin=0.0, beam=8, **k).collect()}
    blind = links(recall=0.0)
    missed = [i for i in range(400, 700) if blind[i] < true[i]]
    assert len(missed) > 20 and sum(blind.values()) > 0.99 * true.sum()       # a pooled recall would be content
    got = links()
    assert sum(got[i] < true[i] for i in range(700)) <= 7 and all(got[i] <= true[i] for i in range(700))


def test_few_links_prove_nothing():
    assert embedding_graph.audited(1.0, embedding_graph.PROOF, False, 0.99)
    assert not embedding_graph.audited(1.0, embedding_graph.PROOF - 1, False, 0.99)
    assert embedding_graph.audited(1.0, 0, True, 0.99) and not embedding_graph.audited(0.98, 500, True, 0.99)


def test_pivots_inside_one_group_lose_no_links(spark):
    """Several of a group's vectors are sampled as pivots; the first round has to find the links to them."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = np.concatenate([unit(unit(rng.standard_normal(32)) + 0.018 * rng.standard_normal((150, 32))),
                        unit(rng.standard_normal((250, 32)))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    true = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert (true[:150] > 140).all() and (true[150:] == 0).all()
    got = {r.vec_id: r.n_links for r in embedding_graph.near_duplicates(df, shard=20, recall=0.0).collect()}
    assert sum(got[i] < true[i] for i in range(400)) <= 4 and all(got[i] <= true[i] for i in range(400))


def test_pivots_are_apart_and_as_many_as_wanted():
    rng = np.random.default_rng(13)
    one = rng.standard_normal((40, 8))
    x = np.concatenate([one, one + 0.01 * rng.standard_normal((40, 8)), -one])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = embedding_graph.spread_pivots(x, 30, 0.4)
    cos = got @ got.T - 2 * np.eye(len(got))
    assert len(got) == 30 and cos.max() < np.cos(0.4) and (got[0] == x[0]).all()
    all_of = embedding_graph.spread_pivots(x, 500, 0.4)
    assert len(all_of) <= 80 and ((x @ all_of.T).max(axis=1) >= np.cos(0.4)).all()
    assert len(embedding_graph.spread_pivots(x, 30, 7.0)) == 1
