"""Token counts of texts by rank-synchronous merging of arrays.

The distinct pre-tokens of a slice of texts lie in one flat array of byte symbols, with the
sequence each symbol belongs to. In every round each sequence looks up its own lowest-rank pair
and merges all its occurrences, from left to right where they overlap; all sequences do so
together, in a dozen array operations. Sequences without a known pair leave the array, and
their number of symbols is their token count. A merge can only make pairs of higher ranks
(checked when the table is read), so that merging all occurrences of a pair at once gives what
merging them one by one gives. A sequence of more than ``LONG`` symbols merges by itself, with
its pairs kept in one bucket for each rank, so that a round touches only the pair it merges.

Counts of pre-tokens stay in a bounded cache of the worker, known by their 64-bit hashes.
Nothing is shuffled: a document is counted by the task that reads it.

Defined results
    * A null or empty text has 0 bytes and 0 tokens. A null ``doc_id`` stays null.
    * The added tokens of the file are one token each where a text holds their literals (the
      default of the tokenizers library); what lies between them is pre-tokenised by itself.
    * Repeated rows are counted each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code
from litrank.llm.text_arrays import code_point_hashes, pretoken_starts, text_column, text_rows, text_slices
from litrank.llm.token_ids import added_tokens, byte_symbols

LONG = 2048
CACHE_WORDS = 1 << 18
SLICE = 1 << 18
NO_PAIR = np.iinfo(np.int32).max

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                     ("over_limit", pa.bool_())])


@dataclass
class MergeTable:
    """``pairs`` (left id * size + right id) ascending, the rank of each, the id each rank makes."""
    first: np.ndarray          # symbol of each byte
    pairs: np.ndarray
    ranks: np.ndarray
    makes: np.ndarray
    size: int

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_PAIR)


def merge_table(path: str) -> MergeTable:
    """The merges of a byte-level BPE in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                           "byte_fallback", "ignore_merges"))
    if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") \
            or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    ids, size = model["vocab"], max(model["vocab"].values()) + 1
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    born: dict[str, int] = {}
    for rank, (a, b) in enumerate(merges):
        if max(born.get(a, -1), born.get(b, -1)) >= rank or born.setdefault(a + b, rank) != rank:
            raise ValueError(f"{path}: merge {rank} uses or makes a token out of order")
        if (len(a) > 1 and a not in born) or (len(b) > 1 and b not in born):
            raise ValueError(f"{path}: merge {rank} uses a token that no merge before it makes")
    key = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
    order = np.argsort(key)
    sign = byte_symbols()
    return MergeTable(np.array([ids[sign[b]] for b in range(256)], np.int64), key[order],
                      order.astype(np.int32), np.array([ids[a + b] for a, b in merges], np.int64), size)


def merge_batch(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence; sequences lie one after the other and are not empty."""
    counts = np.zeros(len(lengths), np.int64)
    who = np.arange(len(lengths))
    seq = np.repeat(who, lengths)
    rank = np.full(len(symbols), NO_PAIR, np.int32)     # of the pair that begins at each symbol
    inner = np.flatnonzero(seq[1:] == seq[:-1])
    rank[inner] = table.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        size = np.diff(np.append(begin, len(symbols)))
        least = np.minimum.reduceat(rank, begin)
        done = least == NO_PAIR
        counts[seq[begin[done]]] = size[done]
        if done.any():
            keep = np.repeat(~done, size)
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            least, size = least[~done], size[~done]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        # In a run of overlapping occurrences every second one merges, from the left.
        fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(fresh, place, 0))
        hit = hit[(place - run) % 2 == 0]
        symbols[hit] = table.makes[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        at = np.cumsum(keep)[hit] - 1
        symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
        for i in (at, at[at > 0] - 1):                  # the pairs that the new symbols are part of
            last = i + 1 >= len(symbols)
            j = np.where(last, i, i + 1)
            new = table.rank(symbols[i], symbols[j])
            rank[i] = np.where(last | (seq[i] != seq[j]), NO_PAIR, new)
    return counts


def merge_long(table: MergeTable, symbols: np.ndarray) -> int:
    """Symbols left of one long sequence: a linked list of symbols, and a bucket of places for
    each rank. A round takes the lowest rank's bucket, and drops places merged meanwhile."""
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    rank = np.full(n, NO_PAIR, np.int32)
    rank[:-1] = table.rank(symbols[:-1], symbols[1:])
    buckets: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(places):
        places = places[rank[places] != NO_PAIR]
        if not len(places):
            return
        places = places[np.argsort(rank[places], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[places])) + 1
        for part in np.split(places, cut):
            r = int(rank[part[0]])
            if r not in buckets:
                buckets[r] = []
                heapq.heappush(queue, r)
            buckets[r].append(part)

    put(np.arange(n - 1))
    left = n
    while queue:
        r = heapq.heappop(queue)
        hit = np.unique(np.concatenate(buckets.pop(r)))
        hit = hit[alive[hit] & (rank[hit] == r)]
        if not len(hit):
            continue
        fresh = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(fresh, place, 0))
        hit = hit[(place - run) % 2 == 0]
        gone = after[hit]
        symbols[hit] = table.makes[r]
        alive[gone] = False
        rank[gone] = NO_PAIR
        after[hit] = after[gone]
        tail = after[hit] < n
        before[after[hit][tail]] = hit[tail]
        left -= len(hit)
        touched = np.unique(np.concatenate([hit, before[hit][before[hit] >= 0]]))
        nxt = after[touched]
        safe = np.minimum(nxt, n - 1)
        rank[touched] = np.where(nxt < n, table.rank(symbols[touched], symbols[safe]), NO_PAIR)
        put(touched)
    return left


class TokenCounter:
    """Counts the tokens of slices of texts, with a bounded cache of the counts of pre-tokens."""

    def __init__(self, table: MergeTable, added: dict[str, int] | None = None, words: int = CACHE_WORDS):
        self.table, self.words = table, words
        longest = sorted(added or {}, key=len, reverse=True)
        self.literals = re.compile("|".join(map(re.escape, longest))) if longest else None
        self._forget()

    def _forget(self):
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _merged(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of the words ``cp[starts:ends]``, none of them empty."""
        size = ends - starts
        at = np.cumsum(size) - size
        cp = cp[np.repeat(starts - at, size) + np.arange(size.sum())]
        wide = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000), out=wide[1:])
        buf = np.frombuffer(cp.tobytes().decode("utf-32-le").encode(), np.uint8)
        begin, end = wide[at], wide[at + size]
        length = end - begin
        out = np.ones(len(starts), np.int64)
        for i in np.flatnonzero(length > LONG):
            out[i] = merge_long(self.table, self.table.first[buf[begin[i]:end[i]]])
        short = np.flatnonzero((length > 1) & (length <= LONG))
        keep = np.repeat((length > 1) & (length <= LONG), length)
        out[short] = merge_batch(self.table, self.table.first[buf[keep]], length[short])
        return out

    def _counts(self, cp, starts, ends) -> np.ndarray:
        hashes, first, code = np.unique(code_point_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        out = np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        out[hit] = self.count[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = self._merged(cp, starts[first[new]], ends[first[new]])
            if len(self.known) + len(new) > self.words:
                self._forget()
            if len(new) <= self.words:
                at = np.searchsorted(self.known, hashes[new])
                self.known = np.insert(self.known, at, hashes[new])
                self.count = np.insert(self.count, at, out[new])
        return out[code]

    def _literal_spans(self, text: str, offs: np.ndarray) -> np.ndarray:
        if self.literals is None or next(self.literals.finditer(text), None) is None:
            return np.zeros((0, 2), np.int64)
        rows = zip(offs[:-1].tolist(), offs[1:].tolist())
        return np.array([m.span() for a, z in rows for m in self.literals.finditer(text, a, z)],
                        np.int64).reshape(-1, 2)

    def column(self, col: pa.Array) -> np.ndarray:
        """Number of tokens of each text of an Arrow column without nulls."""
        out = np.zeros(len(col), np.int64)
        for i, j, text, cp, offs in text_rows(col, SLICE):
            if not len(cp):
                continue
            literal = self._literal_spans(text, offs)
            begin, end = literal[:, 0], literal[:, 1]
            cuts = np.unique(np.concatenate([offs, begin, end])) if len(literal) else offs
            starts = pretoken_starts(cp, cuts)
            ends = np.append(starts[1:], len(cp))
            total = np.zeros(len(starts), np.int64)
            plain = np.ones(len(starts), bool)
            if len(literal):                            # a literal is one token, whatever it is cut into
                at = np.searchsorted(begin, starts, "right") - 1
                plain = (at < 0) | (starts >= end[np.maximum(at, 0)])
                total[np.isin(starts, begin)] = 1
            if plain.any():
                total[plain] = self._counts(cp, starts[plain], ends[plain])
            summed = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(total, out=summed[1:])
            out[i:j] = np.diff(summed[np.searchsorted(starts, offs)])
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(merge_table(path), added_tokens(path))
    return _COUNTERS[path]


def _count(batches, path: str, limit: int):
    counter = _counter(path)
    for batch in batches:
        col = text_column(batch)
        size = np.zeros(len(col), np.int64)
        for i, j, _, offs in text_slices(col):
            size[i:j] = np.diff(offs)
        tokens = counter.column(col)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens),
                                          pa.array(tokens > limit)], schema=_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id``, UTF-8 bytes, tokens, and whether there are more than ``limit``, for each row.
    ``tokenizer`` is a JSON file of the tokenizers library with a byte-level BPE."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda x: _count(x, tokenizer, limit), COUNTS)
