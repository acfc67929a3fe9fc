"""Personal data by base rules and a semi-Markov conditional random field.

The base rules find emails, IP addresses, card and phone numbers; their spans always stay. The
random field adds spans that the rules miss: two card numbers side by side (which one rule
match swallows and drops), numbers that an extra digit group spoils, and secret keys. It scores
whole segments: a segment of a type has features of the complete span (digit count, Luhn sum,
separators, shape) and of its neighbours. Bounded-entity dynamic programming (a segment has at
most MOST_TOKENS tokens) chooses boundaries and types together. Weights are trained by the
conditional likelihood (forward and backward sums over all segmentations) on a bounded sample
of regions of the corpus, labelled by the rules where the rules are sure.

A region is a run of blank-separated words that hold a digit or an @; only segments inside a
region can be entities, so other text costs one scan.

Defined results
    * A null text is the empty text and has no spans. Offsets are code points, ends exclusive.
    * Spans are ordered by start, then by kind (email, ip, card, phone, secret). Base spans of
      different kinds may overlap; an added span overlaps no other span.
    * ``n_email`` to ``n_phone`` count the base spans of the kind.
    * Repeated rows are scanned each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import hash_share, ship_code
from litrank.llm.text_arrays import text_column

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MOST_TOKENS = 40

# The base rules. The look-behinds and possessive repeats match the same spans as the plain
# forms, without trying again inside a run that failed.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEED = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _found(rx: re.Pattern, text: str, *span: int) -> bool:
    return next(rx.finditer(text, *span), None) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start and kind."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _found(_DIGIT, text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- regions and segments ----------------------------------------------------------------------

def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words that hold a digit or an @."""
    if not _found(_SEED, text):
        return []
    out: list[list[int]] = []
    joined = False
    for m in _WORD.finditer(text):
        a, b = m.span()
        if _found(_SEED, text, a, b):
            if joined and a - out[-1][1] == 1:
                out[-1][1] = b
            else:
                out.append([a, b])
            joined = True
        else:
            joined = False
    return [(a, b) for a, b in out]


_HEX = re.compile(r"[0-9A-Fa-f]+\Z")
_NAMED = re.compile(r"(?:token|key|secret|password|passwd|pwd|auth)\s*[=:]\s*[\"']?\Z", re.I)


def _whole_email(s: str) -> bool:
    m = _EMAIL.match(s)
    return bool(m and m.end() == len(s))


def segment_features(text: str, a: int, b: int, kind: str) -> list[str] | None:
    """Whole-span features of a candidate; None if the span cannot be of the kind at all."""
    s = text[a:b]
    digits = sum(c.isdigit() and c.isascii() for c in s)
    before, after = text[a - 1:a], text[b:b + 1]
    out = [f"{kind}", f"{kind}:before={_shape(before)}", f"{kind}:after={_shape(after)}"]
    if kind == "email":
        if s.count("@") != 1 or " " in s:
            return None
        return [*out, f"email:whole={_whole_email(s)}", f"email:dots={min(3, s.split('@')[1].count('.'))}"]
    if kind == "ip":
        if s.count(".") != 3 or digits != len(s) - 3:
            return None
        parts = s.split(".")
        good = all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
        return [*out, f"ip:parts={good}"]
    if kind == "card":
        rest = s.replace(" ", "").replace("-", "")
        if not 14 <= digits <= 19 or len(rest) != digits or not (s[0].isdigit() and s[-1].isdigit()):
            return None
        return [*out, f"card:digits={digits}", f"card:luhn={luhn(rest)}", f"card:parts={min(6, len(s) - digits)}"]
    if kind == "phone":
        if not 10 <= digits <= 15 or s[0] not in "+(0123456789" or not s[-1].isdigit() or \
                any(c not in " ().-+0123456789" for c in s):
            return None
        groups = len(re.findall(r"[0-9]+", s))
        return [*out, f"phone:plus={s[0] == '+'}", f"phone:groups={min(6, groups)}", f"phone:digits={digits}",
                f"phone:brackets={'(' in s}"]
    if len(s) < 20 or not s.isalnum() or not s.isascii() or digits == 0:
        return None
    return [*out, f"secret:hex={bool(_HEX.match(s))}", f"secret:letters={digits < len(s)}",
            f"secret:named={_found(_NAMED, text[max(0, a - 24):a])}", f"secret:long={len(s) >= 32}"]


def _shape(c: str) -> str:
    return "end" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def candidates(text: str, region: tuple[int, int]):
    """Token bounds of a region and its candidate segments: (first, last + 1, kind, features)."""
    lo, hi = region
    bounds = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
    found = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+(") or not first.isascii():
            if first not in "._%-":
                continue
        digits = 0
        for j in range(i + 1, min(i + MOST_TOKENS, len(bounds) - 1) + 1):
            piece = text[bounds[j - 1]:bounds[j]]
            digits += sum(c.isdigit() for c in piece)
            if digits > 400:
                break
            if not piece[-1].isalnum():
                continue
            for kind in KINDS:
                feats = segment_features(text, bounds[i], bounds[j], kind)
                if feats is not None:
                    found.append((i, j, kind, feats))
    return bounds, found


class SemiMarkovField:
    """Weights of segment features. A token outside an entity is a segment of score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _scores(self, found):
        return [sum(self.weights.get(f, 0.0) for f in feats) for _, _, _, feats in found]

    def best(self, text: str, region) -> list[tuple[int, int, str]]:
        """The spans of the best segmentation of a region."""
        bounds, found = candidates(text, region)
        if not found:
            return []
        n = len(bounds) - 1
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        ending: dict[int, list[int]] = {}
        score = self._scores(found)
        for k, (_, j, _, _) in enumerate(found):
            ending.setdefault(j, []).append(k)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending.get(j, ()):
                v = value[found[k][0]] + score[k]
                if v > value[j] + 1e-12:
                    value[j], back[j] = v, k
        out, j = [], n
        while j > 0:
            k = back[j]
            if k is None:
                j -= 1
            else:
                out.append((bounds[found[k][0]], bounds[j], found[k][2]))
                j = found[k][0]
        return out[::-1]

    def _gradient(self, n, found, score, gold):
        """Observed minus expected presence of each candidate."""
        ending, starting = {}, {}
        for k, (i, j, _, _) in enumerate(found):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        alpha = np.zeros(n + 1)
        beta = np.zeros(n + 1)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[found[k][0]] + score[k] for k in ending.get(j, ()))])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[found[k][1]] + score[k] for k in starting.get(i, ()))])
        return [(k in gold) - float(np.exp(alpha[i] + score[k] + beta[j] - alpha[n]))
                for k, (i, j, _, _) in enumerate(found)]

    @classmethod
    def train(cls, sample: list[tuple[str, int, int]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3):
        """``sample``: (text, start, end) of regions with some text around them."""
        field = cls()
        data = []
        for text, a, b in sample:
            bounds, found = candidates(text, (a, b))
            if not found:
                continue
            sure = {s for s in base_spans(text) if a <= s[0] and s[1] <= b} | _sure_secrets(text, a, b)
            at = {v: i for i, v in enumerate(bounds)}
            places = {(at[s], at[e], kind) for s, e, kind in sure if s in at and e in at}
            if len(places) < len(sure):
                continue
            gold = {k for k, (i, j, kind, _) in enumerate(found) if (i, j, kind) in places}
            spoiled = any(m for m in _CARD.finditer(text, a, b) if len(_DIGIT.findall(m.group())) > 19)
            if not spoiled and len(gold) == len(places):        # the rules are not sure of such regions
                data.append((len(bounds) - 1, found, gold))
        for turn in range(rounds):
            step = rate / (1 + turn)
            for n, found, gold in data:
                diff = field._gradient(n, found, field._scores(found), gold)
                for g, (_, _, _, feats) in zip(diff, found):
                    if abs(g) > 1e-4:
                        for f in feats:
                            w = field.weights.get(f, 0.0)
                            field.weights[f] = w + step * (g - decay * w)
        return field


def _sure_secrets(text, a, b):
    return {(m.start(), m.end(), "secret") for m in re.finditer(r"[0-9A-Za-z]{20,}+", text)
            if a <= m.start() and m.end() <= b and _found(_NAMED, text[max(0, m.start() - 24):m.start()])
            and _found(_DIGIT, m.group())}


def all_spans(text: str, field: SemiMarkovField) -> tuple[list, list]:
    """Base spans, and base with added spans."""
    base = base_spans(text)
    spans = list(base)
    taken = sorted((a, b) for a, b, _ in base)
    reach = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    for region in regions(text):
        for a, b, kind in field.best(text, region):
            k = bisect.bisect_left(taken, (b, -1))
            if not k or reach[k - 1] <= a:
                spans.append((a, b, kind))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def describe(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the jobs ----------------------------------------------------------------------------------

def _snippets(batches):
    for batch in batches:
        out = []
        for text in text_column(batch).to_pylist():
            for a, b in regions(text):
                if b - a <= 400:
                    lo = max(0, a - 24)
                    out.append((text[lo:b + 2], a - lo, b - lo))
        yield pa.RecordBatch.from_pydict({"snippet": pa.array([s for s, _, _ in out], pa.string()),
                                          "a": pa.array([a for _, a, _ in out], pa.int32()),
                                          "b": pa.array([b for _, _, b in out], pa.int32())})


def fit(docs: DataFrame, sample: int = 1200, documents: int = 40_000) -> SemiMarkovField:
    """Train on at most ``sample`` regions of about ``documents`` documents, chosen by hashes of
    their texts."""
    ship_code(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.where(hash_share(["text"], documents, texts.count())).mapInArrow(_snippets, "snippet string, a int, b int")
    rows = found.orderBy(F.xxhash64("snippet", "a"), "snippet", "a").limit(sample).collect()
    return SemiMarkovField.train([(r["snippet"], r["a"], r["b"]) for r in rows])


def _find(batches, weights):
    field = SemiMarkovField(weights.value)
    for batch in batches:
        both = [all_spans(t, field) for t in text_column(batch).to_pylist()]
        kinds = [[k for _, _, k in base] for base, _ in both]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([k.count(kind) for k in kinds], pa.int64()) for kind in BASE),
             pa.array([describe(base) for base, _ in both], pa.string()),
             pa.array([describe(spans) for _, spans in both], pa.string())],
            names=["doc_id", *(f"n_{kind}" for kind in BASE), "base_spans", "spans"])


def find_spans(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """Per document: doc_id, counts of base spans, base_spans and spans (``kind:start:end,...``)."""
    spark = docs.sparkSession
    ship_code(spark)
    weights = spark.sparkContext.broadcast(field.weights)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return rows.mapInArrow(lambda x: _find(x, weights), f"doc_id bigint, {counts}, base_spans string, spans string")


def redacted(text: str, field: SemiMarkovField) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in all_spans(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(batches, weights):
    field = SemiMarkovField(weights.value)
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts = [None if t is None else redacted(t, field) for t in batch.column(k).cast(pa.string()).to_pylist()]
        cols = list(batch.columns)
        cols[k] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def redact(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced by their kinds; the other columns stay."""
    spark = docs.sparkSession
    ship_code(spark)
    weights = spark.sparkContext.broadcast(field.weights)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda x: _redact(x, weights), schema)
