"""Language-model scoring with a probabilistic suffix tree (Ron, Singer & Tishby 1996).

A text is read as symbols: the bytes of its words (A-Z lower-cased), a blank after each word,
and an end symbol. The tree holds contexts of up to DEPTH symbols (the order of the model). A
context is retained on its own evidence, whatever its share of the corpus: its next-symbol
distribution diverges from that of its longest proper suffix, ``n * KL > least_gain`` and
``KL > least_divergence``. So the tree grows with what the corpus shows of each context, and a
language with a hundredth of the text keeps the contexts it has enough text for. Distributions
are smoothed towards that of the suffix with ``strength`` pseudo-counts. A text is scored symbol
by symbol in the state of the longest retained suffix of what came before.

The tree stays a table: the counts of all symbols after all contexts of DEPTH training symbols.
Contexts that end in the same two symbols lie in one hash group, which therefore has the counts of
all its contexts of two symbols and more, and runs their tests by itself; the distributions of
shorter contexts, at most 65,792 numbers, are the only part that every task gets.

Texts to score are cut into chunks of CHUNK_BYTES. The distinct (context, symbol) pairs of a chunk
are exchanged by hash, each distinct pair of the corpus is looked up once in its group of the
tree, and the answers go back by the same hash to the chunks, which sum them. ``score_words``
gives the unigram score of the words with additive smoothing by the same exchange: the distinct
words of every chunk (64-bit hashes) are counted over the whole corpus. The number of hash parts
follows the bytes of the corpus.

Defined results
    * A null text is the empty text: one token, the end. Rows with a null ``doc_id`` are scored
      and, as no fold can be given to them, not learned from by the registered query.
    * Without training texts the unigram score is that of unseen tokens and the tree is the
      uniform distribution. A NUL byte in a text counts as the byte 1.
    * Repeated rows are scored each, and teach as often as they occur. Other columns are
      ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.packed import pack, unpack
from litrank.llm.stages import ship_code, shuffle_width, stored
from litrank.llm.text_arrays import LOWER, byte_span_hashes, mix, text_column, text_slices, word_spans

DEPTH = 4
CHUNK_BYTES = 4 << 20
TASK_GRAMS = 1 << 21
# Bytes of text whose distinct words and pairs one part of the exchange serves.
PART_BYTES = 48 << 20
_U = np.uint64
# Pairs of the tree that one task tests and looks up, about.
GROUP_PAIRS = 1 << 19


def symbols(buf: np.ndarray, offsets: np.ndarray, spans=None):
    """The symbol stream of a slice and the place after each row's end symbol. Every row is
    preceded by DEPTH zeros, which are context only."""
    low = LOWER[buf]
    low[low == 0] = 1
    starts, ends, row = spans if spans is not None else word_spans(low, offsets)
    rows = len(offsets) - 1
    words = np.bincount(row, minlength=rows)
    size = np.ones(len(starts) + rows, np.int64)                 # a word and a blank, or an end
    begin = np.zeros(len(starts) + rows, np.int64)
    word_at = np.arange(len(starts)) + row
    end_at = np.cumsum(words) + np.arange(rows)
    size[word_at] = ends - starts + 1
    begin[word_at] = starts
    size[end_at] = 1 + DEPTH                                     # its zeros come before the next row
    total = np.cumsum(size)
    out = np.zeros(DEPTH + int(total[-1]) if len(total) else DEPTH, np.uint8)
    body = np.repeat(begin - (total - size), size) + np.arange(len(out) - DEPTH)
    value = np.append(low, np.uint8(0))[np.minimum(body, len(low))]
    value[total[word_at] - 1] = 0x20
    for k in range(1 + DEPTH):
        value[total[end_at] - 1 - k] = 0
    out[DEPTH:] = value
    return out, DEPTH + total[end_at] - DEPTH


def _predicted(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of the symbols that are predicted: all but the zeros before a row."""
    out = np.ones(len(stream), bool)
    out[:DEPTH] = False
    for k in range(DEPTH):
        out[np.minimum(ends + k, len(stream) - 1)] = False
    if len(ends):
        out[ends[-1]:] = False
    return out


def _codes(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each predicted symbol with the DEPTH symbols before it, as one integer."""
    code = np.zeros(len(stream), np.uint64)
    for k in range(DEPTH, -1, -1):
        code[DEPTH:] = (code[DEPTH:] << _U(8)) | stream[DEPTH - k:len(stream) - k]
    return code[_predicted(stream, ends)]


def _merge(grams, counts):
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], (np.add.reduceat(c, first) if len(first) else c)


def _count_grams(batches):
    """(context, symbol, n) of the texts of a task; the context is DEPTH bytes as an integer."""
    grams, counts, held = [], [], 0

    def rows(g, c):
        return pa.RecordBatch.from_pydict({"context": pa.array((g >> _U(8)).astype(np.int64)),
                                           "symbol": pa.array((g & _U(255)).astype(np.int16)),
                                           "n": pa.array(c.astype(np.int64))})

    for batch in batches:
        for _, _, buf, offs in text_slices(text_column(batch)):
            stream, ends = symbols(buf, offs)
            g, c = np.unique(_codes(stream, ends), return_counts=True)
            grams.append(g)
            counts.append(c)
            held += len(g)
            if held > TASK_GRAMS:
                g, c = _merge(grams, counts)
                if len(g) > TASK_GRAMS // 2:
                    yield rows(g, c)
                    g, c = g[:0], c[:0]
                grams, counts, held = [g], [c], len(g)
    if held:
        yield rows(*_merge(grams, counts))


@dataclass
class SuffixTree:
    """``counts`` (context, symbol, n): the stored table of all training pairs. ``short``: the smoothed
    probabilities after each single symbol and whether that context is retained, ``root`` those after none."""
    counts: DataFrame
    root: np.ndarray            # 256
    short: np.ndarray           # 256 x 256
    kept: np.ndarray            # 256
    strength: float
    least_gain: float
    least_divergence: float

    @property
    def tests(self):
        return self.strength, self.least_gain, self.least_divergence

    def states(self) -> DataFrame:
        """The retained contexts of two symbols and more: (context, depth, n, kl)."""
        model = self.root, self.short, self.kept, *self.tests
        return self.counts.groupBy(_group_of("context", _groups(self.counts)).alias("grp")).applyInArrow(
            lambda table: _states(table, model), "context bigint, depth int, n bigint, kl double")


def _group_of(context, groups: int):
    """The group of a context, by a hash of its last two symbols: contexts with the same longer suffix lie
    in the same group."""
    c = F.col(context) if isinstance(context, str) else context
    return F.pmod(F.xxhash64(c.bitwiseAND((1 << 16) - 1)), F.lit(groups)).cast("int")


def _groups(pairs: DataFrame) -> int:
    return max(shuffle_width(pairs.sparkSession), pairs.count() // GROUP_PAIRS)


def _divergence(n, up, of, size):
    """n and KL of each of ``size`` contexts from the counts ``n`` of their symbols (contexts ``of``) and
    the probabilities ``up`` of the symbols after the context's suffix."""
    total = np.bincount(of, n, size)
    share = n / np.maximum(total[of], 1)
    kl = np.bincount(of, share * np.log(np.maximum(share, 1e-300) / up), size)
    return total, kl


def _short_states(pairs, strength: float, least_gain: float, least_divergence: float):
    """Root, smoothed rows and retained marks from the counts after each single symbol."""
    count = np.zeros((256, 256))
    for context, symbol, n in pairs:
        count[context, symbol] = n
    root = (count.sum(axis=0) + 0.5) / (count.sum() + 128)
    total = count.sum(axis=1, keepdims=True)
    seen = np.nonzero(count)
    n, kl = _divergence(count[seen], root[seen[1]], seen[0], 256)
    return root, (count + strength * root) / (total + strength), (n * kl > least_gain) & (kl > least_divergence)


def _levels(context, symbol, n, model):
    """For pairs (context of DEPTH symbols, symbol, count) that are whole groups, and distinct: yields for
    each length d from 2 on the context of each pair, as a number and its names, with n, KL and whether it
    is retained, and the smoothed probability of each pair's symbol after it."""
    root, short, kept, strength, least_gain, least_divergence = model
    p = short[context & 255, symbol]
    for d in range(2, DEPTH + 1):
        names, of = np.unique(context & ((1 << 8 * d) - 1), return_inverse=True)
        pairs, first, which = np.unique((of << 8) | symbol, return_index=True, return_inverse=True)
        count = np.bincount(which, n, len(pairs))
        total, kl = _divergence(count, p[first], of[first], len(names))
        p = (count[which] + strength * p) / (total[of] + strength)
        yield d, names, of, total, kl, (total * kl > least_gain) & (kl > least_divergence), p


def _arrays(table, *names):
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _states(table, model):
    out = [(names[keep], np.full(keep.sum(), d), total[keep], kl[keep])
           for d, names, _, total, kl, keep, _ in _levels(*_arrays(table, "context", "symbol", "n"), model)]
    context, depth, n, kl = (np.concatenate(v) for v in zip(*out))
    return pa.table({"context": pa.array(context), "depth": pa.array(depth.astype(np.int32)),
                     "n": pa.array(n.astype(np.int64)), "kl": pa.array(kl)})


def _look_up(asked, counted, model):
    """log10 probability of each asked pair (gram) of a group in the state of its longest retained suffix."""
    want = np.unique(asked.column("gram").to_numpy().astype(np.int64))
    context, symbol, n = _arrays(counted, "context", "symbol", "n")
    gram = np.concatenate([(context << 8) | symbol, want])
    names, code = np.unique(gram, return_inverse=True)
    n = np.bincount(code, np.concatenate([n, np.zeros(len(want))]), len(names))
    context, symbol = names >> 8, names & 255
    root, short, kept = model[:3]
    best = np.where(kept[context & 255], short[context & 255, symbol], root[symbol])
    for _, _, of, _, _, keep, p in _levels(context, symbol, n, model):
        best = np.where(keep[of], p, best)
    at = np.searchsorted(names, want)
    return pa.table({"gram": pa.array(want), "log_p": pa.array(np.log10(best[at]))})


def fit(texts: DataFrame, strength: float = 8.0, least_gain: float = 20.0,
        least_divergence: float = 0.005) -> SuffixTree:
    """Learn the tree from all rows of ``texts`` (column text)."""
    ship_code(texts.sparkSession)
    rows = texts.select(F.col("text").cast("string").alias("text"))
    counts = stored(rows.mapInArrow(_count_grams, "context bigint, symbol smallint, n bigint")
                    .groupBy("context", "symbol").agg(F.sum("n").alias("n")), "contexts")
    last = F.col("context").bitwiseAND(255).cast("int").alias("last")
    pairs = counts.groupBy(last, "symbol").agg(F.sum("n").alias("n")).collect()     # 65,536 at most
    tests = strength, least_gain, least_divergence
    return SuffixTree(counts, *_short_states(pairs, *tests), *tests)


# --- words and scores --------------------------------------------------------------------------

_CHUNKS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("grams", pa.binary()),
                     ("docs", pa.binary()), ("texts", pa.binary()), ("train_docs", pa.int64()),
                     ("train_words", pa.int64())])
CHUNKS = ("chunk bigint, part int, words binary, grams binary, docs binary, texts binary, "
          "train_docs bigint, train_words bigint")


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64)) >> _U(32)) % _U(parts)).astype(np.int32)


def _read(buf: np.ndarray, offsets: np.ndarray, places: bool):
    """Of a slice: the hashes of its words, the words of each row, the distinct pairs of its symbols; with
    ``places`` also which pair each symbol is, and the symbols of each row."""
    low = LOWER[buf]
    starts, ends, row = spans = word_spans(low, offsets)
    stream, stops = symbols(buf, offsets, spans)
    words = byte_span_hashes(low, starts, ends), np.bincount(row, minlength=len(offsets) - 1)
    if not places:
        return *words, np.unique(_codes(stream, stops))
    upto = np.zeros(len(stream) + 1, np.int64)
    np.cumsum(_predicted(stream, stops), out=upto[1:])
    grams, which = np.unique(_codes(stream, stops), return_inverse=True)
    return *words, grams, which.astype(np.int32), np.diff(np.concatenate([[0], upto[stops]]))


def _describe(batches, parts: int):
    """For each chunk: a row with its documents (ids, texts), and for each part a row with its distinct
    words, how often they occur in training texts, and its distinct pairs."""
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def chunk():
        ids, learn, bufs, offsets, hashes, counts, grams = (list(v) for v in zip(*held))
        names, code = np.unique(np.concatenate(hashes), return_inverse=True)
        taught = np.bincount(code[np.repeat(np.concatenate(learn), np.concatenate(counts))], minlength=len(names))
        pairs = np.unique(np.concatenate(grams))
        part, pair_part = _part_of(names, parts), _part_of(pairs, parts)
        flat = [d for i in ids for d in i]
        null = np.array([d is None for d in flat], np.uint8)
        key = np.array([0 if d is None else d for d in flat], np.int64).view(np.uint64)
        sizes = np.concatenate([np.diff(o) for o in offsets])
        rows = [(number, -1, None, None, pack(key, null, sizes, np.array([len(i) for i in ids])),
                 pack(np.concatenate(bufs)), int(np.concatenate(learn).sum()), int(taught.sum()))]
        rows += [(number, int(p), pack(names[part == p], taught[part == p]), pack(pairs[pair_part == p]), None, None, 0, 0)
                 for p in np.union1d(part, pair_part)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    for batch in batches:
        docs, learn = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
        for i, j, buf, offs in text_slices(text_column(batch)):
            hashes, counts, grams = _read(buf, offs, False)
            held.append((docs[i:j], learn[i:j], buf, offs, hashes, counts, grams))
            size += len(buf)
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size, number = [], 0, number + 1
    if held:
        yield chunk()


def _count_words(table):
    """The corpus counts of the words of each chunk, and the number of distinct training words."""
    asked = [unpack(b) for b in table.column("words").to_pylist()]
    names, code = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
    n = np.bincount(code, np.concatenate([c for _, c in asked]).astype(float), len(names)).astype(np.int64)
    cut = np.cumsum([0, *(len(a) for a, _ in asked)])
    replies = [pack(n[code[a:b]]) for a, b in zip(cut, cut[1:])]
    distinct = [int((n > 0).sum())] + [0] * (len(asked) - 1)
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"),
                     "words": pa.array(replies, pa.binary()), "distinct": pa.array(distinct, pa.int64())})


def _distinct_grams(table):
    """The distinct pairs that the chunks ask a part for."""
    return pa.table({"gram": pa.array(np.unique(np.concatenate(
        [unpack(b)[0] for b in table.column("grams").to_pylist()])))})


def _answer(asked, known):
    """The log10 probabilities of the pairs of each chunk, in their order."""
    gram, log_p = known.column("gram").to_numpy(), known.column("log_p").to_numpy().astype(np.float32)
    order = np.argsort(gram)
    gram, log_p = gram[order], log_p[order]
    replies = [log_p[np.searchsorted(gram, unpack(b)[0])].tobytes() for b in asked.column("grams").to_pylist()]
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "grams": pa.array(replies, pa.binary())})


def _sum_scores(table, parts: int):
    part = table.column("part").to_pylist()
    main = part.index(-1)
    key, null, sizes, rows = unpack(table.column("docs")[main].as_py())
    buf = unpack(table.column("texts")[main].as_py())[0].astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.concatenate([[0], np.cumsum(rows)])
    slices = [_read(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True) for a, b in zip(cut, cut[1:])]
    names = np.unique(np.concatenate([s[0] for s in slices]))
    pairs = np.unique(np.concatenate([s[2] for s in slices]))
    part_names, part_pairs = _part_of(names, parts), _part_of(pairs, parts)
    n, log_p = np.zeros(len(names), np.int64), np.zeros(len(pairs))
    for p, words, grams in zip(part, table.column("words").to_pylist(), table.column("grams").to_pylist()):
        if words is not None:
            n[part_names == p] = unpack(words)[0]
        if grams is not None:
            log_p[part_pairs == p] = np.frombuffer(grams, np.float32)

    def by_row(values, counts):
        """Sums of the values of each row, each by itself: a row's sum does not depend on the others."""
        out = np.zeros(len(counts), values.dtype)
        full = counts > 0
        if full.any():
            out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
        return out

    words, known, logs, scores = [], [], [], []
    for hashes, counts, grams, which, size in slices:
        seen = n[np.searchsorted(names, hashes)]
        words.append(counts)
        known.append(by_row((seen > 0).astype(np.int64), counts))
        logs.append(by_row(np.log10(seen + 0.1), counts))
        scores.append(by_row(log_p[np.searchsorted(pairs, grams)][which], size))
    return pa.table({"doc_id": pa.array(key.view(np.int64), pa.int64(), mask=null.astype(bool)),
                     "n_words": pa.array(np.concatenate(words), pa.int64()),
                     "known": pa.array(np.concatenate(known), pa.int64()),
                     "log_counts": pa.array(np.concatenate(logs), pa.float64()),
                     "score": pa.array(np.concatenate(scores), pa.float64())})


def score(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """``docs`` has doc_id, text and learn (whether the row teaches the word counts). Returns
    doc_id, n_tokens, n_known, train_tokens, base_score (unigram) and score (the tree)."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("learn"), F.lit(False)).alias("learn"),
                       F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_width(spark), size // PART_BYTES)
    chunks = stored(rows.mapInArrow(lambda x: _describe(x, parts), CHUNKS), "lm-chunks")
    asked = chunks.where("part >= 0").select("chunk", "part", "words", "grams")
    # The pairs: distinct ones, looked up in the groups of the tree, and back to their parts.
    model = tree.root, tree.short, tree.kept, *tree.tests
    distinct = stored(asked.select("part", "grams").groupBy("part").applyInArrow(_distinct_grams, "gram bigint"), "lm-asked")
    groups = max(_groups(distinct), _groups(tree.counts))
    wanted = distinct.select("gram", _group_of(F.shiftright("gram", 8), groups).alias("grp"))
    counted = tree.counts.select("context", "symbol", "n", _group_of("context", groups).alias("grp"))
    known = wanted.groupBy("grp").cogroup(counted.groupBy("grp")).applyInArrow(
        lambda a, b: _look_up(a, b, model), "gram bigint, log_p double")
    known = stored(known.mapInArrow(lambda x: _with_part(x, parts), "gram bigint, log_p double, part int"), "lm-known")
    answers = asked.select("chunk", "part", "grams").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        _answer, "chunk bigint, part int, grams binary")
    replies = stored(asked.select("chunk", "part", "words").groupBy("part").applyInArrow(
        lambda table: _count_words(table), "chunk bigint, part int, words binary, distinct bigint"), "lm-words")
    train_docs, train_words = chunks.where("part < 0").agg(F.sum("train_docs"), F.sum("train_words")).first()
    train_docs, train_words = train_docs or 0, train_words or 0
    words = (replies.agg(F.sum("distinct")).first()[0] or 0) + (train_docs > 0)
    total = train_docs + train_words
    none = lambda *names: {c: F.lit(None).cast("binary") for c in names}
    sums = chunks.where("part < 0").select("chunk", "part", "docs", "texts").withColumns(none("words", "grams")) \
        .unionByName(replies.drop("distinct").withColumns(none("docs", "texts", "grams"))) \
        .unionByName(answers.withColumns(none("docs", "texts", "words"))).repartition(parts, "chunk") \
        .groupBy("chunk").applyInArrow(
            lambda table: _sum_scores(table, parts),
            "doc_id bigint, n_words bigint, known bigint, log_counts double, score double")
    norm = float(np.log10(total + 0.1 * (words + 1)))
    n_tokens = F.col("n_words") + 1
    return sums.select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("known") + int(train_docs > 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + float(np.log10(train_docs + 0.1)) - n_tokens * norm).alias("base_score"), "score")


def _with_part(batches, parts: int):
    for batch in batches:
        part = _part_of(batch.column(0).to_numpy(), parts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["gram", "log_p", "part"])
