"""Near-duplicate embeddings by a robust-pruned flat graph.

Two vectors link if their labels are equal and not null, and their cosine is at least
``threshold`` in double precision.

1. Equal vectors of a label are one class with a weight, so that a vector that is repeated a
   million times is one node.
2. The vectors of a label are cut into cluster shards around pivots (a sampled vector for each
   ``shard`` vectors, at most MOST_PIVOTS in all), no two of them within twice the angle of the
   threshold, so that whatever links with a pivot has it as its nearest. Shards overlap: a vector
   belongs to every pivot that is at most ``margin`` radians farther than the nearest one, its home.
3. Each shard builds a robust-pruned graph (Subramanya et al. 2019): a node keeps its nearest
   candidate, drops the candidates that this neighbour is close to, and so on. The adjacency
   lists that a vector got in different shards are united.
4. In its home shard every vector walks the united graph: a greedy walk with a beam from
   the nearest medoid and from its own node, which then expands every node inside the range (and
   a little beyond) until no new one turns up. Cosines are computed in double precision; a link is
   a pair found with cosine >= threshold, from either end if both walk in the shard.
5. Links are counted with weights, and joined to components; of a shard only a forest of its
   links leaves the task.
6. An audit compares up to ``audit`` distinct vectors, those with an id divisible by 100 first, with
   brute force over all rows. What counts is the share of audited vectors with links that have all
   of their links, each vector once, so that a huge group cannot hide small ones; fewer than PROOF
   such vectors prove nothing, unless the audit covers the whole table. Until the share reaches
   ``recall``, margin and beam grow and steps 2 to 5 run again, up to the margin at which two
   vectors that link surely share a shard (twice the angle of the threshold); there it is an error
   if the share is below 0.9.

Shards of more than MOST_NODES nodes are cut into parts, their queries into blocks of the same
size; each block meets each part, so that a task's memory is bounded while no pair is left
out.

Defined results
    * Vectors that are null, empty, zero, or hold null or non-finite components, and rows with
      a null label, link with nothing: n_links 0, their own component. Vectors of different
      lengths do not link.
    * Rows that repeat a ``vec_id`` are vectors of their own, and give a row each. A null
      ``vec_id`` can have links; its component is the smallest non-null id in it, or null, and
      it is never kept.
    * Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import components, hash_share, join_groups, ship_code, stored

MOST_PIVOTS = 4096
MOST_NODES = 4096
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
# Audited vectors with links that make an audit count.
PROOF = 30


def _vectors(column) -> np.ndarray:
    """Unit vectors (double precision) of a column of equally long arrays."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- shards ------------------------------------------------------------------------------------

def spread_pivots(x: np.ndarray, wanted: int, apart: float) -> np.ndarray:
    """Up to ``wanted`` of the unit vectors ``x``, in their order, each more than ``apart`` radians from
    those before it. Two pivots inside one group of similar vectors would each miss the other, and
    every vector of the group with one of them as its home would lose a link."""
    kept = np.empty((min(wanted, len(x)), x.shape[1]))
    n, bound = 0, np.cos(min(apart, np.pi))
    for v in x:
        if n == len(kept):
            break
        if not n or (kept[:n] @ v).max() < bound:
            kept[n] = v
            n += 1
    return kept[:n]


def _assign(batches, pivots, margin: float):
    """(shard, class, home) of each vector; groups without pivots are one shard."""
    table = pivots.value
    for batch in batches:
        ids = batch.column(0).to_numpy()
        groups = np.array(batch.column(1).to_pylist(), object)
        shard, at, home = [], [], []
        for g in np.unique(groups.astype(str)) if len(groups) else []:
            rows = np.flatnonzero(groups == g)
            if g not in table:
                shard += [g] * len(rows)
                at.append(rows)
                home.append(np.ones(len(rows), bool))
                continue
            x = _vectors(batch.column(2).take(pa.array(rows)))
            angle = np.arccos(np.clip(x @ table[g].T, -1, 1))
            r, p = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + margin)
            shard += [f"{g}/{k}" for k in p]
            at.append(rows[r])
            home.append(angle.argmin(axis=1)[r] == p)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        home = np.concatenate(home) if home else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.string()), pa.array(ids[at], pa.int64()), pa.array(home, pa.bool_()),
             batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))],
            names=["shard", "class_id", "home", "embedding", "weight"])


# --- graph -------------------------------------------------------------------------------------

def robust_graph(x: np.ndarray, degree: int = DEGREE, near: int = CANDIDATES, alpha: float = ALPHA,
                 block: int = 256) -> list[np.ndarray]:
    """Neighbours of each node: robust pruning of its nearest nodes and some far ones. Single precision
    is enough to choose them; links are found by the cosines of ``range_walk``."""
    n, x = len(x), x.astype(np.float32)
    rng = np.random.default_rng(n)
    far = min(16, max(0, n - 1))
    out = []
    for lo in range(0, n, block):
        rows = np.arange(lo, min(n, lo + block))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        k = min(near, n - 1)
        if k < 1:
            out += [np.zeros(0, np.int64)] * len(rows)
            continue
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        cand = np.concatenate([cand, rng.integers(0, n, (len(rows), far))], axis=1)
        own = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        dist = np.sqrt(np.maximum(2 - 2 * own, 0))
        alive = np.isfinite(own)
        vec = x[cand]
        gram = vec @ vec.transpose(0, 2, 1)
        keep = [[] for _ in rows]
        every = np.arange(len(rows))
        for _ in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = alive.argmax(axis=1)
            for r in every[some]:
                keep[r].append(cand[r, best[r]])
            between = gram[every, best]
            alive &= alpha * np.sqrt(np.maximum(2 - 2 * between, 0)) > dist
            alive[every, best] = False
        out += [np.array(v, np.int64) for v in keep]
    return out


def _build(table):
    x = _vectors(table.column("embedding"))
    ids = table.column("class_id").to_numpy()
    lists = robust_graph(x)
    return pa.table({"class_id": pa.array(ids, pa.int64()),
                     "near": pa.array([ids[v] for v in lists], pa.list_(pa.int64()))})


def range_walk(x: np.ndarray, near: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int,
               block: int = 256, own: np.ndarray | None = None):
    """Yield (queries, nodes) index pairs with cosine >= threshold that the walk meets.
    ``near`` are local neighbour lists, used in both directions; ``own`` has the node of a query
    that is a node itself (else -1), where its walk starts as well. A query keeps the ``beam`` best
    nodes it met, so that a step costs what it meets, whatever the number of nodes."""
    n = len(x)
    src = np.repeat(np.arange(n), [len(v) for v in near])
    dst = np.concatenate(near) if n else np.zeros(0, np.int64)
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = both // n, both % n
    begin = np.searchsorted(src, np.arange(n + 1))
    degree = np.diff(begin)
    # Medoids: the nodes closest to the means of a few cells.
    seeds = x[:: max(1, n // 32)][:32]
    cell = (x @ seeds.T).argmax(axis=1)
    medoids = [int((x[m] @ x[m].mean(axis=0)).argmax()) for m in (np.flatnonzero(cell == c) for c in range(len(seeds)))
               if len(m)]
    medoids = np.array([np.flatnonzero(cell == cell_no)[k] for cell_no, k in
                        zip([c for c in range(len(seeds)) if (cell == c).any()], medoids)])
    slack = np.cos(np.arccos(threshold) * 1.25)        # expand nodes a little outside the range
    own = np.full(len(queries), -1) if own is None else own
    for lo in range(0, len(queries), block):
        q, self_at = queries[lo:lo + block], own[lo:lo + block]
        rows = np.arange(len(q))
        seen = np.zeros(len(q) * n, bool)
        mark = np.zeros(len(q) * n, np.int32)          # picks one of equal pairs
        pool = np.full((len(q), beam), -np.inf)        # the best nodes met so far, in no order
        at = np.zeros((len(q), beam), np.int64)
        fresh = np.zeros((len(q), beam), bool)         # not yet expanded
        start = medoids[(q @ x[medoids].T).argmax(axis=1)]
        selves = (self_at >= 0) & (self_at != start)
        r, node = np.concatenate([rows, rows[selves]]), np.concatenate([start, self_at[selves]])
        found = []
        while len(r):
            seen[r * n + node] = True
            value = np.concatenate([np.einsum("bd,bd->b", q[r[s:s + 65536]], x[node[s:s + 65536]])
                                    for s in range(0, len(r), 65536)])
            hit, within = value >= threshold, value >= slack
            found.append((r[hit], node[hit]))
            wide = r[within], node[within]              # in range: expanded all at once
            better = value > pool.min(axis=1)[r]
            r, node, value, within = r[better], node[better], value[better], within[better]
            order = np.lexsort((-value, r))
            r, node, value, within = r[order], node[order], value[order], within[order]
            some, first, size = np.unique(r, return_index=True, return_counts=True)
            rank = np.arange(len(r)) - np.repeat(first, size)
            top = rank < beam
            line, rank = np.repeat(np.arange(len(some)), size)[top], rank[top]
            width = int(rank.max()) + 1 if len(rank) else 0
            new = np.full((len(some), width), -np.inf)
            new_at, new_fresh = np.zeros(new.shape, np.int64), np.zeros(new.shape, bool)
            new[line, rank], new_at[line, rank], new_fresh[line, rank] = value[top], node[top], ~within[top]
            every = np.concatenate([pool[some], new], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            pool[some] = np.take_along_axis(every, best, axis=1)
            at[some] = np.take_along_axis(np.concatenate([at[some], new_at], axis=1), best, axis=1)
            fresh[some] = np.take_along_axis(np.concatenate([fresh[some], new_fresh], axis=1), best, axis=1)
            value = np.where(fresh, pool, -np.inf)
            top = np.argpartition(-value, min(4, beam) - 1, axis=1)[:, :min(4, beam)]
            go, place = np.nonzero(np.isfinite(np.take_along_axis(value, top, axis=1)))
            place = top[go, place]
            fresh[go, place] = False
            r, node = np.concatenate([go, wide[0]]), np.concatenate([at[go, place], wide[1]])
            d = degree[node]
            pair = np.repeat(r, d) * n + dst[np.repeat(begin[node] - (np.cumsum(d) - d), d) + np.arange(int(d.sum()))]
            pair = pair[~seen[pair]]
            mark[pair] = np.arange(len(pair))
            pair = pair[mark[pair] == np.arange(len(pair))]
            r, node = pair // n, pair % n
        a, b = (np.concatenate(v) for v in zip(*found))
        yield a + lo, b


def _walk_shard(table, threshold: float, beam: int):
    """Link counts of the queries of one unit, and a forest of the links of the unit."""
    kind = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
    ids = table.column("class_id").to_numpy()
    weight = table.column("weight").to_numpy()
    x = _vectors(table.column("embedding"))
    near = table.column("near").to_pylist()
    order = np.flatnonzero(~kind)[np.argsort(ids[~kind], kind="stable")]
    nodes, node_w, node_x = ids[order], weight[order], x[order]
    ask = np.flatnonzero(kind)
    q_ids, q_x = ids[ask], x[ask]
    if not len(nodes) or not len(q_ids):
        return _links_table([], [], [], [])
    local = []
    for k in order:
        v = np.array(near[k] or [], np.int64)
        at = np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)
        local.append(at[nodes[at] == v])
    names = np.unique(np.concatenate([nodes, q_ids]))
    q_at, n_at = np.searchsorted(names, q_ids), np.searchsorted(names, nodes)
    label = np.arange(len(names))
    own = np.minimum(np.searchsorted(nodes, q_ids), len(nodes) - 1)
    own = np.where(nodes[own] == q_ids, own, -1)
    linked = np.zeros((len(q_ids), len(nodes)), bool)
    for a, b in range_walk(node_x, local, q_x, threshold, beam, own=own):
        linked[a, b] = True
    both = np.flatnonzero(own >= 0)                     # a pair met from one end is a link of the other too
    linked[np.ix_(both, own[both])] |= linked[np.ix_(both, own[both])].T
    linked[both, own[both]] = False
    count = np.array([node_w[row].sum() for row in linked], np.int64)
    a, b = np.nonzero(linked)
    a, b = q_at[a], n_at[b]
    while len(a):                                       # smallest name along the links
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return _links_table(q_ids, count, names[moved], names[label[moved]])


def _links_table(q, count, a, b):
    n, m = len(q), len(a)
    return pa.table({"class_id": pa.array([*q, *[None] * m], pa.int64()),
                     "n_links": pa.array([*count, *[None] * m], pa.int64()),
                     "a": pa.array([*[None] * n, *a], pa.int64()), "b": pa.array([*[None] * n, *b], pa.int64())})


# --- audit -------------------------------------------------------------------------------------

def _brute(batches, sample, threshold: float):
    """Links of the sampled vectors to the vectors of a task, by brute force. The sample holds
    (classes, unit vectors) for each group."""
    groups = sample.value
    total = {g: np.zeros(len(ids), np.int64) for g, (ids, _) in groups.items()}
    for batch in batches:
        own, group = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
        weight = batch.column(3).to_numpy()
        for g in set(group) & set(groups):
            ids, x = groups[g]
            part = np.flatnonzero(group == g)
            y = _vectors(batch.column(2).take(pa.array(part)))
            hit = (x @ y.T >= threshold) & (ids[:, None] != own[part][None, :])
            total[g] += (hit * weight[part][None, :]).sum(axis=1)
    ids = [i for g in groups for i in groups[g][0].tolist()]
    yield pa.RecordBatch.from_pydict({"class_id": pa.array(ids, pa.int64()),
                                      "n": pa.array([n for g in groups for n in total[g].tolist()], pa.int64())})


# --- the operator ------------------------------------------------------------------------------

def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, group, embedding): group is null where the vector links with nothing."""
    e = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & (F.size(e) > 0) & \
        F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    group = F.concat_ws(":", F.col("label").cast("string"), F.size(e).cast("string"))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.when(F.coalesce(usable, F.lit(False)), group).alias("grp"), e.alias("embedding")) \
        .withColumn("class_id", F.xxhash64("grp", "embedding"))


def audited(share: float, linked: int, whole: bool, recall: float) -> bool:
    """Does an audit prove the recall? ``linked`` audited vectors have links, ``share`` of them all theirs."""
    return (whole or linked >= PROOF) and share >= recall


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = 1024, margin: float = 0.12,
                    beam: int = 32, recall: float = 0.99, audit: int = 2048) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id,
    kept."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = stored(_clean(vectors), "vectors")
    able = rows.where("grp is not null")
    classes = stored(able.groupBy("class_id").agg(
        F.first("grp").alias("grp"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"),
        F.min("vec_id").alias("least_id"), F.max(F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))).alias("asked")),
        "classes")
    nodes = classes.select("class_id", "grp", "embedding", "weight")
    total = nodes.count()
    near = F.col("asked") | hash_share(["class_id"], 2 * audit + 100, total)
    sample = classes.where(near & (~F.col("asked") | hash_share(["class_id"], 2 * audit + 100, max(total // 100, 1)))) \
        .orderBy(F.desc("asked"), F.xxhash64("class_id", F.lit(1)), "class_id") \
        .limit(audit).select("class_id", "grp", "embedding").toArrow()
    names = np.array(sample.column(1).to_pylist(), object)
    picked = {}
    for g in sorted(set(names)):
        at = pa.array(np.flatnonzero(names == g))
        picked[g] = sample.column(0).combine_chunks().take(at).to_numpy(), _vectors(sample.column(2).combine_chunks().take(at))
    picked = spark.sparkContext.broadcast(picked)
    truth = {r["class_id"]: r["n"] for r in nodes.mapInArrow(
        lambda b: _brute(b, picked, threshold), "class_id bigint, n bigint")
        .groupBy("class_id").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    sure = 2 * float(np.arccos(min(threshold, 1.0)))
    while True:
        counts, edges = _graph_links(nodes, threshold, shard, margin, beam)
        found = {r["class_id"]: r["n_links"] for r in
                 counts.where(F.col("class_id").isin([int(i) for i in truth] or [0])).collect()}
        share = sum(found.get(i, 0) >= n for i, n in truth.items()) / max(len(truth), 1) if truth else 1.0
        if audited(share, len(truth), len(names) >= total, recall):
            break
        if margin >= sure:
            if share < 0.9:
                raise RuntimeError(f"{share:.3f} of the audited vectors have all their links, at the widest margin")
            break
        margin, beam = min(max(1.6 * margin, sure / 8), sure), 2 * beam
    of = components(edges).withColumnRenamed("node", "class_id")
    smallest = of.join(classes.select("class_id", "least_id"), "class_id")
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    groups = stored(
        classes.select("class_id", "least_id", "weight").join(counts, "class_id", "left")
        .join(smallest.select("class_id", "component_id"), "class_id", "left")
        .select("class_id", "weight", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component_id", "least_id").alias("component_id")), "vector-classes")
    linked = join_groups(able.select("vec_id", "class_id"), groups, "class_id", "weight", able.count()) \
        .select("vec_id", "n_links", "component_id")
    alone = rows.where("grp is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _graph_links(nodes: DataFrame, threshold: float, shard: int, margin: float, beam: int):
    spark = nodes.sparkSession
    total = nodes.count()
    target = max(shard, total // MOST_PIVOTS)
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > 2 * target)
    wanted, order = F.ceil(F.col("n") / target), F.pmod(F.xxhash64("class_id", F.lit(2)), F.lit(2 ** 31))
    # twice as many as wanted, as some are too near to others
    chosen = nodes.join(F.broadcast(sizes), "grp").where(order < F.lit(float(2 ** 32)) * wanted / F.col("n")) \
        .select("grp", "embedding", wanted.cast("int").alias("wanted"), order.alias("order"), "class_id").toArrow() \
        .sort_by([("order", "ascending"), ("class_id", "ascending")]).combine_chunks()
    pivots: dict[str, np.ndarray] = {}
    names = np.array(chosen.column(0).to_pylist(), object)
    apart = 2 * float(np.arccos(min(threshold, 1.0)))
    for g in sorted(set(names)):
        own = chosen.take(pa.array(np.flatnonzero(names == g)))
        pivots[g] = spread_pivots(_vectors(own.column(1)), own.column(2)[0].as_py(), apart)
    shared = spark.sparkContext.broadcast(pivots)
    members = nodes.mapInArrow(lambda b: _assign(b, shared, margin),
                               "shard string, class_id bigint, home boolean, embedding array<double>, weight bigint")
    members = stored(members, "members")
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("q"))
    cut = F.ceil(F.col("n") / MOST_NODES).cast("int")
    ask = F.ceil(F.col("q") / MOST_NODES).cast("int")
    members = stored(members.join(sizes, "shard").select(
        "shard", "class_id", "home", "embedding", "weight", cut.alias("parts"), F.greatest(ask, F.lit(1)).alias("asks"),
        F.pmod(F.xxhash64("class_id", F.lit(3)), cut).cast("int").alias("part"),
        F.pmod(F.xxhash64("class_id", F.lit(4)), F.greatest(ask, F.lit(1))).cast("int").alias("ask")), "units")
    lists = members.groupBy("shard", "part").applyInArrow(lambda table: _build(table),
                                                          "class_id bigint, near array<bigint>")
    united = stored(lists.groupBy("class_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")),
                    "adjacency")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    graph = members.join(united, "class_id").select(
        "shard", "part", upto("asks").alias("ask"), "class_id", "embedding", "weight", "near",
        F.lit(False).alias("query"))
    asked = members.where("home").select(
        "shard", upto("parts").alias("part"), "ask", "class_id", "embedding", "weight",
        F.lit(None).cast("array<bigint>").alias("near"), F.lit(True).alias("query"))
    found = stored(graph.unionByName(asked).groupBy("shard", "part", "ask").applyInArrow(
        lambda table: _walk_shard(table, threshold, beam), "class_id bigint, n_links bigint, a bigint, b bigint"), "found")
    counts = stored(found.where("class_id is not null").groupBy("class_id").agg(F.sum("n_links").alias("n_links")),
                    "link-counts")
    return counts, found.where("a is not null").select("a", "b")
