"""Token ids of texts, one encoder call for each distinct pre-token.

A byte-level BPE encodes the pre-tokens of a text one by one, so that its ids are those of its
pre-tokens in order. A slice of texts is split with array operations, its distinct pre-tokens
are looked up in a cache of the worker, and only unknown ones reach the tokenizer library. The
cache is bounded: beyond ``limit`` words it starts anew.

The added tokens of a JSON file are found in texts first, as ``Tokenizer.encode(text,
add_special_tokens=False)`` does: each is one id, and what lies between is pre-tokenised piece
by piece.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from litrank.llm.text_arrays import code_point_hashes, pretoken_starts, text_rows

WORD_LIMIT = 1_000_000


def byte_symbols() -> dict[int, str]:
    """The printable sign that byte-level BPE files write for each byte: itself where it is
    printable, else the next sign from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def json_word_encoder(path: str):
    """Ids of one pre-token by the tokenizers library, for a byte-level BPE in its JSON form."""
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path).model
    table = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
    return lambda word: [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(table))]


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a JSON file, which are found in texts as they are written."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens) \
            or len({t["normalized"] for t in tokens}) > 1:
        raise ValueError(f"{path}: added tokens that strip blanks, match whole words or differ in normalisation")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


class TextEncoder:
    """Encodes slices of texts with a word encoder and a bounded cache. ``added`` has the ids of
    literals that are cut out of the texts first: leftmost, then longest."""

    def __init__(self, encode_word, limit: int = WORD_LIMIT, added: dict[str, int] | None = None):
        self.added = added or {}
        # What is cut out never is, or holds, a pre-token of the rest, so that both share the cache.
        self.encode_word = lambda w: [self.added[w]] if w in self.added else encode_word(w)
        longest = sorted(self.added, key=len, reverse=True)
        self.literals = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.limit = limit
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes, words):
        ids = [self.encode_word(w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for w in ids for i in w), np.uint32, int(size.sum()))
        if len(self.known) + len(hashes) > self.limit:
            self._forget()
            return hashes, size, flat
        begin = len(self.pool) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.pool = np.concatenate([self.pool, flat])
        return None

    def _lookup(self, hashes, word_of):
        """Begin, size and pool of the ids of each hash (sorted, distinct)."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        hit = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        if not hit.all():
            new = np.flatnonzero(~hit)
            old = self.begin, self.size, self.pool
            spare = self._learn(hashes[new], [word_of(i) for i in new])
            if spare is not None:            # the cache was full: this slice keeps what it has
                begin, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
                begin[hit], size[hit] = old[0][at[hit]], old[1][at[hit]]
                size[new] = spare[1]
                begin[new] = len(old[2]) + np.cumsum(spare[1]) - spare[1]
                return begin, size, np.concatenate([old[2], spare[2]])
            at = np.searchsorted(self.known, hashes)
        return self.begin[at], self.size[at], self.pool

    def _word_starts(self, text: str, cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where the pre-tokens and added tokens of a slice begin; none reaches over rows."""
        if self.literals is None or next(self.literals.finditer(text), None) is None:
            return pretoken_starts(cp, offs)
        found = [m.span() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist())
                 for m in self.literals.finditer(text, a, z)]
        if not found:                        # only across the ends of rows
            return pretoken_starts(cp, offs)
        begin, end = np.array(found, np.int64).T
        starts = pretoken_starts(cp, np.unique(np.concatenate([offs, begin, end])))
        at = np.searchsorted(begin, starts, "right") - 1
        inside = (at >= 0) & (starts > begin[at]) & (starts < end[at])
        return starts[~inside]

    def slices(self, col: pa.Array):
        """Yield ``(first_row, last_row, ids, offsets)``: the ids of row i of the slice are
        ``ids[offsets[i]:offsets[i + 1]]``."""
        for i, j, text, cp, offs in text_rows(col):
            starts = self._word_starts(text, cp, offs)
            if not len(starts):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            ends = np.append(starts[1:], len(cp))
            hashes, first, code = np.unique(code_point_hashes(cp, starts, ends),
                                            return_index=True, return_inverse=True)
            begin, size, pool = self._lookup(hashes, lambda k: text[starts[first[k]]:ends[first[k]]])
            size, begin = size[code], begin[code]
            total = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            ids = pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
            yield i, j, ids, total[np.searchsorted(starts, offs)]


_ENCODERS: dict[str, TextEncoder] = {}


def json_encoder(path: str) -> TextEncoder:
    """The encoder of this worker for a JSON file of the tokenizers library."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(json_word_encoder(path), added=added_tokens(path))
    return _ENCODERS[path]
