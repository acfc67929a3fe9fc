"""Array views of a text column, shared by the operators of this package.

Arrow hands a batch of texts to a task as one byte buffer with offsets. The functions
here split that buffer into words or pre-tokens, and hash them, for a whole slice of rows
at once, so that no operator loops over words in Python. A slice holds about
``SLICE_BYTES`` of text (one row at least), which bounds the temporary arrays of a task.

Null texts are empty texts everywhere in this module.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# The white space bytes of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Code points with the Unicode property White_Space.
UNICODE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002,
                 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029,
                 0x202F, 0x205F, 0x3000)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(ASCII_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    base = 0x5851F42D4C957F2D

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[starts:ends]``; ``values`` are 64-bit symbol codes."""
    n = len(values)
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ROOT)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def text_slices(col: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, last_row, bytes, offsets)`` of consecutive rows of a text array."""
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """Words (maximal runs of non-space bytes) of a slice: starts, ends, row of each word."""
    n = len(buf)
    word = ~IS_SPACE[buf]
    cut = np.zeros(n + 1, bool)          # a row begins here
    cut[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def byte_span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_SYMBOL[buf], starts, ends)


def word_hashes(buf: np.ndarray, offsets: np.ndarray):
    """Hashes of the words of a slice after lower-casing A-Z; starts, ends, row of each word."""
    low = LOWER[buf]
    starts, ends, row = word_spans(low, offsets)
    return byte_span_hashes(low, starts, ends), starts, ends, row


# --- pre-tokens -----------------------------------------------------------------------------

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    major = bytearray(0x110000)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        major[cp] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    out = np.frombuffer(bytes(major), np.uint8).copy()
    out[list(UNICODE_SPACE)] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pretoken_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of rows ``cp[offsets[i]:offsets[i+1]]``.

    The rule is that of ``public_tokenizers.PATTERN``: runs of letters, of numbers or of
    other visible signs, each with one space (U+0020) before it if there is one; the
    contractions 's 't 're 've 'm 'll 'd where an apostrophe begins a pre-token; and runs of
    white space, whose last sign stands alone, or joins the run after it if it is U+0020.
    Every code point belongs to one pre-token, so that starts alone describe the split.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    fresh = np.ones(n, bool)                       # a run of one class begins
    fresh[1:] = (kind[1:] != kind[:-1]) | cut[1:n]
    space = kind == SPACE
    begin = fresh.copy()
    # The last white space of a run that is followed by a visible sign begins a pre-token.
    before_visible = np.zeros(n, bool)
    before_visible[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
    begin |= before_visible
    # A U+0020 there takes the run after it along, which then begins no pre-token.
    glue = before_visible & (cp == 0x20)
    begin[1:] &= ~glue[:-1]
    # Contractions: an apostrophe that is a run of its own and begins a pre-token.
    quote = np.flatnonzero((cp == 0x27) & begin & fresh)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~cut[quote + 1]]
    if len(quote):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        row_end = offsets[np.searchsorted(offsets, quote, "right")]
        one, two = pad[quote + 1], np.where(quote + 2 < row_end, pad[quote + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | \
            ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 1), (quote[long], 2)):
            begin[at + 1] = False
            nxt = at + 1 + size
            nxt = nxt[nxt < n]
            begin[nxt] |= True
    return np.flatnonzero(begin)


def text_rows(col: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, last_row, string, code points, offsets)`` of consecutive rows."""
    for i, j, buf, offs in text_slices(col, limit):
        text = buf.tobytes().decode("utf-8")
        cp = code_points(text)
        if len(cp) == len(buf):
            yield i, j, text, cp, offs
        else:
            lead = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
            yield i, j, text, cp, lead[offs]


def code_point_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(mix((cp.astype(np.uint64) + _U(1)) * _ROOT), starts, ends)


# --- letters -----------------------------------------------------------------------------------

# ASCII letters lower-cased, other ASCII signs blank, bytes of other characters as they are.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = 0x20
LETTERS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def letter_runs(buf: np.ndarray, offsets: np.ndarray):
    """The rows of a slice as lower-case letters between blanks: one blank before each row and
    one after the last. Returns the bytes and the place of each row's leading blank."""
    rows = len(offsets) - 1
    out = np.full(len(buf) + rows + 1, 0x20, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    low = LETTERS[buf]
    if len(buf) > 1:   # capital letters of the Latin-1 block (second byte 0x80 to 0x9E)
        second = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3) & (buf[1:] != 0x97)) + 1
        low[second] += 0x20
    out[np.arange(len(buf)) + row + 1] = low
    return out, offsets + np.arange(rows + 1)


def gram_codes(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position on as one integer (n at most 7)."""
    code = buf[:len(buf) - n + 1].astype(np.uint64)
    for k in range(1, n):
        code = (code << _U(8)) | buf[k:len(buf) - n + 1 + k]
    return code


def has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.zeros(len(col), bool)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[ord("a"):ord("z") + 1] = ascii_letter[ord("A"):ord("Z") + 1] = True
    for i, j, buf, offs in text_slices(col):
        seen = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(ascii_letter[buf], out=seen[1:])
        out[i:j] = np.diff(seen[offs]) > 0
        for k in np.flatnonzero(~out[i:j]):
            rest = buf[offs[k]:offs[k + 1]]
            if (rest >= 0x80).any():
                out[i + k] = bool((char_classes()[code_points(rest.tobytes().decode())] == LETTER).any())
    return out
