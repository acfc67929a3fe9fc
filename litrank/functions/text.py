"""Text column expressions.

All of them are built-in Spark expressions, so they stay in the JVM and run
inside the scan stage of whatever plan uses them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from litrank.constants import QUERY_PUNCTUATION

# Whitespace as Python's str.isspace() sees it: Unicode White_Space plus the
# four information separators U+001C..U+001F. Written so that Java regex and
# RE2 read it the same way.
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# The same set as explicit characters, for translate and trim (no regex).
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\x20\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")
# A Python str-pattern word character: letters, numbers, underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (Python ``str.strip()``)."""
    return F.btrim(_col(c), F.lit(WHITESPACE_CHARS))


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda t: t != F.lit(""))


def normalize_query(c) -> Column:
    """Lower, listed punctuation to spaces, strip, collapse space runs.

    Collapsing splits on single spaces and joins the non-empty parts, which
    keeps other whitespace (newlines) inside the text, as the reference does.
    """
    lowered = F.lower(_col(c))
    spaced = F.translate(lowered, QUERY_PUNCTUATION, " " * len(QUERY_PUNCTUATION))
    return F.array_join(_non_empty(F.split(strip_ws(spaced), " ")), " ")


_TOKEN_BREAKS = QUERY_PUNCTUATION + WHITESPACE_CHARS


def tokenize(c) -> Column:
    """The non-empty runs between whitespace after T1.

    Same tokens as T1 followed by a split on whitespace runs, computed without
    a regex: punctuation and every whitespace character become a space, then
    the text is split on single spaces (Spark's non-regex fast path). A null
    input gives an empty array (D7: null is not the word "None").
    """
    return _non_empty(token_parts(c))


def token_parts(c) -> Column:
    """The tokens of T2, with empty strings between them where there are several breaks: for uses
    that drop those later anyway."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    spaced = F.translate(lowered, _TOKEN_BREAKS, " " * len(_TOKEN_BREAKS))
    return F.split(spaced, " ")


def match_all_tokens(field_tokens, keyword_tokens) -> Column:
    """Every keyword token is an element of the field's tokens.

    An empty keyword matches every field, as ``all([])`` does.
    """
    ft = _col(field_tokens)
    return F.forall(_col(keyword_tokens), lambda k: F.array_contains(ft, k))


def clean_text(c) -> Column:
    """The sentiment cleaning chain, in the reference's order.

    Null becomes "". Two of the reference's steps are no-ops and are left out
    (a punctuation pattern that only matches characters an earlier step
    removed, and a pattern with a literal ``{1,2,3,4}``). The result is
    trimmed; the next step splits on spaces anyway.
    """
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    x = F.regexp_replace(x, f"^(@{WORD_CLASS}+)", "")      # user mention at the start
    x = F.regexp_replace(x, "^(rt @)", "")                  # 'rt @' at the start
    x = F.regexp_replace(x, "[^a-zA-Z0-9]", " ")            # every other character
    x = F.regexp_replace(x, "https.*$", "")                 # from 'https' to the end
    x = F.regexp_replace(x, "amp", "")                      # the letters 'amp'
    return F.trim(x)


def split_words(c) -> Column:
    """Split cleaned text on space runs, no empty words."""
    return F.filter(F.split(_col(c), " +"), lambda t: t != F.lit(""))


def remove_stopwords(c, stopwords: Iterable[str]) -> Column:
    """Drop stop words, keep order and repeats, join with one space.

    ``stopwords`` is a bounded word list; ``isin`` over literals is turned into
    a hash-set lookup by the optimizer, so every word costs O(1).
    """
    words = sorted(set(stopwords))
    if not words:
        return F.array_join(split_words(c), " ")
    kept = F.filter(split_words(c), lambda t: ~t.isin(words))
    return F.array_join(kept, " ")
