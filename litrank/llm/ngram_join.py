"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word
n-grams. The product of the incidence matrix with its transpose is taken block by block, and
every block discards the pairs that a bound derived from the set sizes rules out:

1. Texts with equal sets are one matrix row, named by the digest of the set.
2. Columns (n-grams) are put in one global order, frequent ones last. Two rows of sizes a, b
   that link share ``need = ceil(percent * (a + b) / (100 + percent))`` columns, so that they
   share one among the first ``n - ceil(percent * n / 100) + 1`` columns of each. Only those
   columns are multiplied; this is exact for any global order. The order only has to make
   frequent columns late: it uses the counts of columns that tasks met more than once.
3. Column blocks (by hash range) yield the posting list of each column; equal lists are
   multiplied once. In a list, pairs are cut by size, then by the parity sketch of the two
   rows: ``|A ^ B|`` is at least the number of differing sketch bits, and a linked pair has
   ``|A ^ B| <= a + b - 2 * need``. Lists longer than BLOCK rows are cut into row blocks
   whose pairs are separate keys, so that no task holds a whole long list.
4. Of the pairs that pass, each list first keeps a spanning forest, so that a group of near
   copies costs a row per member and not a row per pair. Their overlap is accumulated over
   column blocks on the full sets and dropped as soon as it cannot reach ``need``; links make
   components.
5. Then the lists are multiplied again for pairs of different components only, all of which
   are tried. After that no link between two components can be left, so that the components
   are those of the full join.
6. On request links are counted: all links of a text lie inside its component. The rows of a
   component, dealt into blocks by size, are multiplied block by block; pairs that size and
   sketch allow are verified there, and a block pair returns a number for each row, no pairs.

Defined results
    * Null, empty and blank texts have no n-grams and link with nothing: they are their own
      component, ``n_shingles`` 0. A text of fewer than ``n`` words has one n-gram, the text.
    * Equal texts and texts with equal sets always link (if not empty).
    * A repeated ``doc_id`` gives one row for each row, with a common component. A null
      ``doc_id`` gives a row whose component is the smallest non-null id of its set's
      component, or null.
    * ``n_links`` counts the other rows that link with a row, its copies among them; a row that
      repeats a ``doc_id`` is another row.
    * Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litrank.llm.stages import components, join_groups, ship_code, shuffle_width, stored
from litrank.llm.text_arrays import mix, text_column, text_slices, word_hashes

LEAST_SKETCH_BITS = 512
BLOCK = 1024                 # rows of a block of a posting list
LATE_COLUMNS = 1 << 20       # most columns that are put late in the order (8 MB, broadcast)
TASK_SHINGLES = 1 << 22      # n-grams a task holds before it passes counts on
COLUMN_BLOCK = 1 << 20       # (column, row) entries of a column block
BLOCK_SHINGLES = 1 << 21     # n-grams of the rows of a block, where links are counted
PAIR_COST = 1 << 20          # multiplications that take as long as one pair by itself

_U = np.uint64
_MULT = mix(np.arange(101, 164, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each row of a slice."""
    h, _, _, row = word_hashes(buf, offsets)
    rows = len(offsets) - 1
    ends = np.cumsum(np.bincount(row, minlength=rows)) if rows else []
    if len(h) >= n:
        grams = h[:len(h) - n + 1] * _MULT[0]
        for k in range(1, n):
            grams += h[k:len(h) - n + 1 + k] * _MULT[k]
        grams = mix(grams)
    out, a = [], 0
    for z in ends:
        if z - a >= n:
            out.append(np.unique(grams[a:z - n + 1]))
        elif z > a:
            out.append(mix((h[a:z] * _MULT[:z - a]).sum(keepdims=True) + _MULT[n + z - a]))
        else:
            out.append(np.zeros(0, _U))
        a = z
    return out


def set_digest(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set of hashes (0 elements: 0)."""
    if not len(s):
        return 0
    h = mix(s + _U(0x632BE59BD9B4E019))
    d = mix(np.array([h.sum() ^ _U(len(s) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)),
                      np.bitwise_xor.reduce(mix(h))], np.uint64))
    return int((d[:1] * _U(3) + d[1:]).astype(np.int64)[0])


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements that hash to each bit; about a bit for each element."""
    size = max(LEAST_SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount((s >> _U(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fold(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches cut to ``words`` 64-bit words: the parity of a coarser hash is the sum of parities."""
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in sketches])


def least_overlap(a, b, percent: int):
    """Fewest common elements of two sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def _batch(fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(fields)


# --- the passes over the text ------------------------------------------------------------------

_SETS = "doc_id bigint, text_hash bigint, n_shingles bigint, digest bigint, sketch binary, columns binary, counts binary"


def _describe(batches, n: int):
    """One row per text (size, digest, sketch), and one row per TASK_SHINGLES n-grams with the
    columns that occurred in more than one text and their counts."""
    pending, size, told = [], 0, set()

    def counts():
        u, c = np.unique(np.concatenate(pending), return_counts=True)
        u, c = u[c > 1], c[c > 1]
        return _batch({"doc_id": pa.array([None], pa.int64()), "text_hash": pa.array([None], pa.int64()),
                       "n_shingles": pa.array([None], pa.int64()), "digest": pa.array([None], pa.int64()), "sketch": pa.array([None], pa.binary()),
                       "columns": pa.array([u.tobytes()], pa.binary()),
                       "counts": pa.array([c.astype(np.int32).tobytes()], pa.binary())})

    for batch in batches:
        ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, j, buf, offs in text_slices(text_column(batch)):
            sets = shingle_sets(buf, offs, n)
            digests = [set_digest(s) for s in sets]
            yield _batch({"doc_id": pa.array(ids[i:j], pa.int64()),
                          "text_hash": pa.array(hashes[i:j], pa.int64()),
                          "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                          "digest": pa.array(digests, pa.int64()),
                          "sketch": pa.array([parity_sketch(s) for s in sets], pa.binary()),
                          "columns": pa.nulls(j - i, pa.binary()), "counts": pa.nulls(j - i, pa.binary())})
            for s, d in zip(sets, digests):
                if d not in told:            # copies in one task count once
                    told.add(d)
                    pending.append(s)
                    size += len(s)
            if size >= TASK_SHINGLES:
                yield counts()
                pending, size, told = [], 0, set()
    if size:
        yield counts()


def _sum_counts(key, table):
    cols = np.concatenate([np.frombuffer(b.as_py(), _U) for b in table.column("columns")])
    cnt = np.concatenate([np.frombuffer(b.as_py(), np.int32) for b in table.column("counts")])
    order = np.argsort(cols, kind="stable")
    cols, cnt = cols[order], cnt[order]
    first = np.flatnonzero(np.append(True, cols[1:] != cols[:-1])) if len(cols) else np.zeros(0, np.int64)
    total = np.add.reduceat(cnt.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return pa.table({"column": cols[first].astype(np.int64), "n": total})


def _split_counts(batches, parts: int):
    """Cut the count rows by column range, so that each range is summed by one task."""
    for batch in batches:
        for cb, nb in zip(batch.column("columns").to_pylist(), batch.column("counts").to_pylist()):
            cols, cnt = np.frombuffer(cb, _U), np.frombuffer(nb, np.int32)
            part = (cols >> _U(40)) % _U(parts)
            order = np.argsort(part, kind="stable")
            cols, cnt, part = cols[order], cnt[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            keep = [p for p in range(parts) if cut[p + 1] > cut[p]]
            yield _batch({"part": pa.array(keep, pa.int32()),
                          "columns": pa.array([cols[cut[p]:cut[p + 1]].tobytes() for p in keep], pa.binary()),
                          "counts": pa.array([cnt[cut[p]:cut[p + 1]].tobytes() for p in keep], pa.binary())})


def late_columns(counts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent columns (sorted) and their classes, log2 of the count. Their number is bounded:
    a column is late if it holds more than one in LATE_COLUMNS of all counted entries."""
    split = counts.mapInArrow(lambda x: _split_counts(x, parts=parts), "part int, columns binary, counts binary")
    summed = stored(split.groupBy("part").applyInArrow(_sum_counts, "column bigint, n bigint"), "columns")
    total = summed.agg(F.sum("n")).first()[0] or 0
    found = summed.where(F.col("n") > max(16, total / LATE_COLUMNS)).toArrow()
    cols = found.column("column").to_numpy().astype(np.uint64)
    order = np.argsort(cols)
    return cols[order], np.log2(found.column("n").to_numpy()[order]).astype(np.uint8)


_POSTINGS = "part int, tokens binary, digests binary, sizes binary"


def _prefixes(batches, n: int, percent: int, late, parts: int):
    """Entries (column, digest, size) of the first columns of each set, packed by column range."""
    cols, classes = late.value
    tok, dig, siz, size, told = [], [], [], 0, set()

    def packed():
        t, d, s = np.concatenate(tok), np.concatenate(dig), np.concatenate(siz)
        part = (t >> _U(40)) % _U(parts)
        order = np.lexsort((t, part))
        t, d, s, part = t[order], d[order], s[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        keep = [p for p in range(parts) if cut[p + 1] > cut[p]]
        return _batch({"part": pa.array(keep, pa.int32()),
                       "tokens": pa.array([t[cut[p]:cut[p + 1]].tobytes() for p in keep], pa.binary()),
                       "digests": pa.array([d[cut[p]:cut[p + 1]].tobytes() for p in keep], pa.binary()),
                       "sizes": pa.array([s[cut[p]:cut[p + 1]].tobytes() for p in keep], pa.binary())})

    for batch in batches:
        for _, _, buf, offs in text_slices(text_column(batch)):
            for s in shingle_sets(buf, offs, n):
                d = set_digest(s)
                if not len(s) or d in told:
                    continue
                told.add(d)
                first = len(s) + percent * len(s) // -100 + 1
                if len(cols):
                    at = np.minimum(np.searchsorted(cols, s), len(cols) - 1)
                    rank = np.where(cols[at] == s, classes[at], 0)
                    s = s[np.argsort(rank, kind="stable")[:first]] if rank.any() else s[:first]
                else:
                    s = s[:first]
                tok.append(s)
                dig.append(np.full(len(s), d, np.int64))
                siz.append(np.full(len(s), 0, np.int32))
                size += len(s)
            if size >= TASK_SHINGLES // 4:
                yield packed()
                tok, dig, siz, size, told = [], [], [], 0, set()
    if size:
        yield packed()


def _posting_lists(key, table):
    """Rows (list, digest, length) of the lists with two texts or more; equal lists are one."""
    tok = np.concatenate([np.frombuffer(b.as_py(), _U) for b in table.column("tokens")])
    dig = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("digests")])
    order = np.lexsort((dig, tok))
    tok, dig = tok[order], dig[order]
    fresh = np.append(True, (tok[1:] != tok[:-1]) | (dig[1:] != dig[:-1]))
    tok, dig = tok[fresh], dig[fresh]
    first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    size = np.diff(np.append(first, len(tok)))
    marks = mix(dig.astype(np.uint64))
    name = mix(np.add.reduceat(marks, first) + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    keep = (size > 1) & np.isin(np.arange(len(first)), np.unique(name, return_index=True)[1])
    each = np.repeat(keep, size)
    return pa.table({"list": np.repeat(name, size)[each].astype(np.int64), "digest": dig[each],
                     "length": np.repeat(size, size)[each].astype(np.int32)})


# --- pairs of a list ---------------------------------------------------------------------------

def _popcounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.int32)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _passing(sizes, sketches, comp, left, right, percent: int, step: int = 256):
    """Index pairs (left block by right block) that sizes and sketches do not rule out."""
    left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
    i = 0
    while i < len(left):
        like = int(np.searchsorted(sizes[left], 2 * sizes[left[i]], "left"))     # sketches of like size
        a = left[i:min(i + step, max(like, i + 1))]
        i += len(a)
        lo, hi = sizes[a].min(), sizes[a].max()
        b = right[(100 * sizes[right] >= percent * lo) & (percent * sizes[right] <= 100 * hi)]
        if not len(b):
            continue
        words = min(min(len(sketches[k]) for k in a), min(len(sketches[k]) for k in b))
        sa, sb = sizes[a][:, None], sizes[b][None, :]
        diff = _popcounts(fold([sketches[k] for k in a], words), fold([sketches[k] for k in b], words))
        ok = (diff <= sa + sb - 2 * least_overlap(sa, sb, percent)) & (a[:, None] != b[None, :])
        ok &= 100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)
        if comp is not None:
            ok &= comp[a][:, None] != comp[b][None, :]
        x, y = np.nonzero(ok)
        yield a[x], b[y], diff[x, y]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _multiply(key, table, percent: int, forest: bool):
    """Candidate pairs of the lists of one key: a spanning forest, or all between components."""
    lists, digest, sizes = (table.column(c).to_numpy() for c in ("list", "digest", "n_shingles"))
    order = np.lexsort((digest, sizes, lists))    # one order, so that both rounds cut the same blocks
    lists, digest, sizes = lists[order], digest[order], sizes[order]
    side = table.column("side").to_numpy()[order]
    comp = None if forest else table.column("component").to_numpy()[order]
    blobs = table.column("sketch").to_pylist()
    sketches = [np.frombuffer(blobs[k], np.uint64) for k in order]
    cut = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    out_a, out_b = [], []
    for lo, hi in zip(cut, np.append(cut[1:], len(lists))):
        at = np.arange(lo, hi)
        left, right = at[side[at] <= 1], at[side[at] != 1]
        whole = bool((side[at] == 0).any())       # one block with itself: each pair once
        found = [(x[x < y], y[x < y], d[x < y]) if whole else (x, y, d)
                 for x, y, d in _passing(sizes, sketches, comp, left, right, percent)]
        if not found:
            continue
        x, y, d = (np.concatenate(v) for v in zip(*found))
        if forest and len(x):
            parent = np.arange(hi - lo)
            keep = []
            for k in np.argsort(d, kind="stable"):
                p, q = _find(parent, x[k] - lo), _find(parent, y[k] - lo)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    keep.append(k)
            x, y = x[keep], y[keep]
        out_a.append(digest[x])
        out_b.append(digest[y])
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _candidates(lists: DataFrame, percent: int, forest: bool, keys: int) -> DataFrame:
    """Pairs of the posting lists. Short lists share ``keys`` keys; a list of more than BLOCK
    rows is cut into row blocks, each pair of blocks being a key of its own."""
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    short = lists.where(F.col("length") <= BLOCK) \
        .select("*", F.pmod("list", F.lit(keys)).alias("k1"), F.lit(-1).alias("k2"), F.lit(-1).alias("k3"),
                F.lit(0).alias("side"))
    mine = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    long = lists.where(F.col("length") > BLOCK).select("*", mine.alias("i"), blocks.alias("m")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")) \
        .select(*lists.columns, F.col("list").alias("k1"), F.least("i", "o").alias("k2"),
                F.greatest("i", "o").alias("k3"),
                F.when(F.col("i") == F.col("o"), 0).when(F.col("i") < F.col("o"), 1).otherwise(2).alias("side"))
    return short.unionByName(long).groupBy("k1", "k2", "k3") \
        .applyInArrow(lambda key, table: _multiply(key, table, percent, forest), "a bigint, b bigint").distinct()


# --- exact overlap -----------------------------------------------------------------------------

ID_BITS = 1 << 26


def _id_bits(wanted: DataFrame) -> np.ndarray:
    """A bit for each hashed digest that is wanted: 8 MB at most, whatever ``wanted`` holds."""
    at = F.pmod(F.col("digest"), F.lit(ID_BITS))
    rows = wanted.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("p")) \
        .groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(ID_BITS, bool)
    for n, bits in rows:
        if n == 0:                                      # the value 0 has a bucket of its own
            out[0] = True
            continue
        part = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        lo = (n - 1) * len(part) + 1
        part = part[:max(0, ID_BITS - lo)]
        out[lo:lo + len(part)] = part
    return np.packbits(out, bitorder="little")


def _wanted_sets(batches, n: int, bits):
    """(digest, set) of the texts that may be wanted; the set as sorted 64-bit hashes."""
    mask = bits.value
    told = set()
    for batch in batches:
        for _, _, buf, offs in text_slices(text_column(batch)):
            out_d, out_s = [], []
            for s in shingle_sets(buf, offs, n):
                d = set_digest(s)
                at = d % ID_BITS
                if len(s) and mask[at >> 3] >> (at & 7) & 1 and d not in told:
                    told.add(d)
                    out_d.append(d)
                    out_s.append(s.tobytes())
            if out_d:
                yield _batch({"digest": pa.array(out_d, pa.int64()), "grams": pa.array(out_s, pa.binary())})
            if len(told) > 1_000_000:
                told.clear()


def _overlap(x: np.ndarray, y: np.ndarray, need: int, edges: np.ndarray) -> bool:
    """Whether two sorted sets share ``need`` elements: the overlap is added up over column
    blocks, and given up as soon as what is left of the smaller set cannot reach ``need``."""
    cx = np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
    cy = np.concatenate([[0], np.searchsorted(y, edges), [len(y)]])
    got = 0
    for k in range(len(cx) - 1):
        u, v = x[cx[k]:cx[k + 1]], y[cy[k]:cy[k + 1]]
        if len(u) and len(v):
            at = np.minimum(np.searchsorted(v, u), len(v) - 1)
            got += int((v[at] == u).sum())
        if got + min(len(x) - cx[k + 1], len(y) - cy[k + 1]) < need:
            return False
    return got >= need


def _accumulate(table, percent: int, blocks: int = 16):
    """The pairs of one key that link. Rows hold a pair (a, b), or a set (digest, grams)."""
    edges = np.arange(1, blocks, dtype=np.uint64) * _U(2 ** 64 // blocks)
    sets, pairs = {}, []
    for a, b, d, g in zip(table.column("a").to_pylist(), table.column("b").to_pylist(),
                          table.column("digest").to_pylist(), table.column("grams")):
        if d is None:
            pairs.append((a, b))
        else:
            sets[d] = np.frombuffer(g.as_buffer(), _U)
    keep = [(a, b) for a, b in pairs
            if _overlap(sets[a], sets[b], least_overlap(len(sets[a]), len(sets[b]), percent), edges)]
    return pa.table({"a": pa.array([a for a, _ in keep], pa.int64()), "b": pa.array([b for _, b in keep], pa.int64())})


def _links(pairs: DataFrame, sets: DataFrame, percent: int, keys: int) -> DataFrame:
    """The pairs that link. Candidate components share keys, so that a set moves once for all
    pairs of its component; one of more than BLOCK texts is cut into pairs of row blocks."""
    of = components(pairs)
    sized = stored(of.join(of.groupBy("component").agg(F.count("*").alias("size")), "component"), "sized")
    part = F.pmod(F.col("component"), F.lit(keys))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    big = F.col("size") > BLOCK
    keyed = stored(pairs.join(sized.withColumnRenamed("node", "a"), "a").select(
        "a", "b", F.when(big, F.col("component")).otherwise(part).alias("k1"),
        F.when(big, block("a")).otherwise(-1).alias("k2"), F.when(big, block("b")).otherwise(-1).alias("k3")), "keyed")
    key = ["k1", "k2", "k3"]
    needs = keyed.select(*key, F.col("a").alias("digest")).union(keyed.select(*key, "b")).distinct()
    rows = needs.join(sets, "digest").select(*key, F.lit(None).cast("bigint").alias("a"),
                                             F.lit(None).cast("bigint").alias("b"), "digest", "grams") \
        .unionByName(keyed.select(*key, "a", "b", F.lit(None).cast("bigint").alias("digest"),
                                  F.lit(None).cast("binary").alias("grams")))
    return rows.groupBy(*key).applyInArrow(lambda table: _accumulate(table, percent), "a bigint, b bigint")


# --- numbers of links --------------------------------------------------------------------------

def _product(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, columns: int = 4096,
             pair_cost: int = PAIR_COST):
    """Overlaps of the row pairs (x, y): the incidence matrices of the rows are multiplied over
    blocks of the columns that occur on both sides. None if that costs more than pair by pair."""
    u, ui = np.unique(x, return_inverse=True)
    v, vi = np.unique(y, return_inverse=True)
    sides = []
    for rows in (u, v):
        flat = np.concatenate([sets[k] for k in rows])
        sides.append((flat, np.repeat(np.arange(len(rows)), [len(sets[k]) for k in rows])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    if len(u) * len(v) * len(both) > pair_cost * len(x):
        return None
    entries = []
    for flat, row in sides:
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        entries.append((at[hit][order], row[hit][order]))
    total = np.zeros((len(u), len(v)), np.int64)
    for c in range(0, len(both), columns):
        part = []
        for (at, row), n in zip(entries, (len(u), len(v))):
            lo, hi = np.searchsorted(at, [c, c + columns])
            m = np.zeros((n, min(columns, len(both) - c)), np.float32)
            m[row[lo:hi], at[lo:hi] - c] = 1
            part.append(m)
        total += (part[0] @ part[1].T).astype(np.int64)
    return total[ui, vi]


def _count_links(table, percent: int, blocks: int = 16, pair_cost: int = PAIR_COST):
    """Copies that each row of one block pair links with in the other block."""
    edges = np.arange(1, blocks, dtype=np.uint64) * _U(2 ** 64 // blocks)
    digest, sizes, copies, side, comp = (table.column(c).to_numpy() for c in
                                         ("digest", "n_shingles", "copies", "side", "component"))
    sketches = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("sketch")]
    sets = [np.frombuffer(b.as_buffer(), _U) for b in table.column("grams")]
    out = np.zeros(len(digest), np.int64)
    order = np.argsort(comp, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        left, right = at[side[at] <= 1], at[side[at] != 1]
        whole = bool((side[at] == 0).any())
        for x, y, _ in _passing(sizes, sketches, None, left, right, percent):
            if whole:                                 # a block with itself: each pair once
                x, y = x[x < y], y[x < y]
            need = least_overlap(sizes[x], sizes[y], percent)
            got = _product(sets, x, y, pair_cost=pair_cost) if len(x) > 256 else None
            if got is None:
                linked = np.array([_overlap(sets[i], sets[j], k, edges) for i, j, k in
                                   zip(x.tolist(), y.tolist(), need.tolist())], bool)
            else:
                linked = got >= need
            x, y = x[linked], y[linked]
            np.add.at(out, x, copies[y])
            np.add.at(out, y, copies[x])
    some = out > 0
    return pa.table({"digest": digest[some], "n": out[some]})


def link_counts(members: DataFrame, sets: DataFrame, percent: int, keys: int) -> DataFrame:
    """(digest, others): the rows of other texts that link with each set. ``members`` has digest,
    component, n_shingles, copies and sketch of the sets that link, ``sets`` their n-grams.

    Rows are dealt into blocks of similar size, about BLOCK rows or BLOCK_SHINGLES n-grams at
    most, by what comes before them in the order of (component, n_shingles), so that most block
    pairs are ruled out by size and never formed. A size that many rows share is cut by a hash of
    the digest."""
    by_size = members.groupBy("component", "n_shingles").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("component").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    share = F.lit(1 / BLOCK) + F.col("n_shingles") / BLOCK_SHINGLES          # of a block, by one row
    by_size = by_size.withColumn("first", F.coalesce(F.sum(F.col("rows") * share).over(before), F.lit(0.0)))
    place = F.col("first") + F.pmod(F.xxhash64("digest"), F.col("rows")) * share
    dealt = stored(members.join(by_size, ["component", "n_shingles"])
                   .withColumn("block", F.floor(place).cast("int")).drop("rows", "first"), "dealt")
    spans = dealt.groupBy("component", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    spans = stored(spans, "spans")
    other = spans.select("component", F.col("block").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    # Two blocks are compared if their ranges of sizes reach into each other's bounds.
    pairs = stored(spans.join(other, "component").where((F.col("block") <= F.col("other"))
                   & (100 * F.col("ohi") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("olo")))
                   .select("component", "block", "other"), "block-pairs")
    same = F.col("block") == F.col("other")
    roles = pairs.select("component", "block", F.col("block").alias("k2"), F.col("other").alias("k3"),
                         F.when(same, 0).otherwise(1).alias("side")) \
        .unionByName(pairs.where(~same).select("component", F.col("other").alias("block"), F.col("block").alias("k2"),
                                               F.col("other").alias("k3"), F.lit(2).alias("side")))
    # Components of one block share keys; the block pairs of larger ones are a key each.
    large = spans.groupBy("component").agg((F.count("*") > 1).alias("large"))
    rows = dealt.join(sets.select("digest", "grams").dropDuplicates(["digest"]), "digest") \
        .join(roles, ["component", "block"]).join(large, "component") \
        .withColumn("k1", F.when(F.col("large"), F.col("component")).otherwise(F.pmod("component", F.lit(keys))))
    return rows.select("k1", "k2", "k3", "component", "side", "digest", "n_shingles", "copies", "sketch", "grams") \
        .groupBy("k1", "k2", "k3").applyInArrow(lambda table: _count_links(table, percent), "digest bigint, n bigint") \
        .groupBy("digest").agg(F.sum("n").alias("others"))


def text_hash(column: str):
    """64-bit hash of a text column as the join reads it."""
    return F.xxhash64(F.col(column).cast("string"))


# --- the operator ------------------------------------------------------------------------------

def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, count_links: bool = False) -> DataFrame:
    """Components of the texts whose n-gram sets have a Jaccard similarity of ``percent`` % or
    more: one row ``(doc_id, n_shingles, component_id, digest, text_hash)`` for each row of ``docs``;
    ``text_hash`` is ``text_hash("text")``, which tells rows of one id, or of none, apart.
    ``count_links`` adds ``n_links``."""
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(texts.withColumn("text_hash", text_hash("text"))
                       .mapInArrow(lambda x: _describe(x, n=n), _SETS), "sets")
    rows = described.where("columns is null").select("doc_id", "text_hash", "n_shingles", "digest")
    filled = rows.where("n_shingles > 0")
    classes = stored(described.where("columns is null and n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"),
        F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")), "classes")
    entries = classes.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1)).first()[0] or 0
    parts = int(max(shuffle_width(spark), float(entries) // COLUMN_BLOCK))
    late = spark.sparkContext.broadcast(
        late_columns(described.where("columns is not null").select("columns", "counts"), shuffle_width(spark)))
    packed = texts.select("text").mapInArrow(
        lambda x: _prefixes(x, n=n, percent=percent, late=late, parts=parts), _POSTINGS)
    lists = packed.groupBy("part").applyInArrow(_posting_lists, "list bigint, digest bigint, length int") \
        .dropDuplicates(["list", "digest"])
    lists = stored(lists.hint("merge").join(
        classes.select("digest", "n_shingles", "sketch").hint("merge"), "digest"), "lists")
    shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    keys = max(4 * shuffle_width(spark), shingles // COLUMN_BLOCK)           # a key holds about 8 MB of sets

    trees = stored(_candidates(lists, percent, True, keys), "trees")
    wanted = trees.select(F.col("a").alias("digest")).union(trees.select("b")).distinct()
    bits = spark.sparkContext.broadcast(_id_bits(wanted))
    sets = texts.select("text").mapInArrow(lambda x: _wanted_sets(x, n=n, bits=bits), "digest bigint, grams binary")
    sets = stored(sets, "wanted")
    links = stored(_links(trees, sets, percent, keys), "links")

    first = components(links)
    named = stored(lists.join(first.withColumnRenamed("node", "digest"), "digest", "left")
                   .withColumn("component", F.coalesce("component", "digest")), "named")
    mixed = named.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("list")
    open_lists = named.join(mixed, "list", "left_semi")
    more = _candidates(open_lists, percent, False, keys)
    more = stored(more.join(trees, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(stored(_links(more, sets, percent, keys), "links"))

    least = classes.select("digest", "least_id")
    joined = components(links).withColumnRenamed("node", "digest")
    if count_links:
        joined = stored(joined, "linked")
    smallest = joined.join(least, "digest").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = joined.join(smallest, "component").select("digest", "component_id")
    groups = classes.select("digest", "least_id", "copies").join(of_class, "digest", "left") \
        .select("digest", "copies", F.coalesce("component_id", "least_id").alias("component_id"))
    if count_links:
        members = joined.join(classes.select("digest", "n_shingles", "copies", "sketch"), "digest")
        groups = groups.join(link_counts(members, sets, percent, keys), "digest", "left") \
            .withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1).drop("others")
    groups = stored(groups, "groups")
    total = filled.count()
    names = ["doc_id", "n_shingles", "component_id", "digest", "text_hash"] + ["n_links"] * count_links
    return join_groups(filled, groups, "digest", "copies", total).select(*names) \
        .unionByName(rows.where("n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "digest", "text_hash",
            F.lit(0).cast("bigint").alias("n_links")).select(*names))
