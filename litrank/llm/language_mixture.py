"""Language identification by multilingual mixture inference.

Fitting counts letter trigrams (hashed) for each language over all labelled texts, in Spark.
A text is a bag of trigrams drawn from a mixture of languages. Expectation-maximisation
estimates its proportions; the language set is the one of highest penalised likelihood among
the best single language and the sets of the most likely two, three, ... languages, where
each further language has to raise the log likelihood by ``penalty * log(trigrams)``
(overlapping trigrams are counted as a third of an observation).

The prediction is the language of the largest proportion; its score is that proportion, or
for a text of one language its probability against the other languages.

Defined results
    * A null text, and a text without a letter, is ``und`` with score 0. So is every text if
      nothing was learned.
    * Ties between languages go to the first in alphabetical order.
    * Rows with null language or null text teach nothing. Repeated rows count each time.
    * Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code
from litrank.llm.text_arrays import gram_codes, has_letter, letter_runs, mix, text_column, text_slices

BUCKETS = 1 << 14
MOST_LANGUAGES = 512          # the model that is broadcast holds BUCKETS values for each
UNKNOWN = "und"


def trigrams(buf: np.ndarray, offsets: np.ndarray):
    """Row and bucket of each letter trigram of a slice (blanks only at its ends)."""
    text, begin = letter_runs(buf, offsets)
    blank = text == 0x20
    at = np.flatnonzero(~blank[1:-1] & ~(blank[:-2] & blank[2:]))
    code = gram_codes(text, 3)[at]
    row = np.searchsorted(begin, at + 1, "right") - 1
    single = np.flatnonzero(~blank[1:-1] & blank[:-2] & blank[2:])        # words of one byte
    code = np.concatenate([code, gram_codes(text, 3)[single]])
    row = np.concatenate([row, np.searchsorted(begin, single + 1, "right") - 1])
    return row, (mix(code + np.uint64(1)) >> np.uint64(50)).astype(np.int64)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, buf, offs in text_slices(text_column(batch)):
            row, bucket = trigrams(buf, offs)
            names = sorted(set(langs[i:j]))
            of_row = np.array([names.index(x) for x in langs[i:j]])
            found = np.bincount(of_row[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
            for k, name in enumerate(names):
                part = found[k * BUCKETS:(k + 1) * BUCKETS]
                total[name] = total.get(name, 0) + part
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()),
                                          "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


class LanguageModel:
    """Log probability of each bucket in each language (rows: buckets; columns: languages)."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p


def fit(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Learn from all rows of ``labelled`` (text, lang)."""
    ship_code(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null") \
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n bigint") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sums.column("lang").to_pylist()
    names = sorted(set(langs))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    count = np.full((BUCKETS, len(names)), smoothing)
    of = {x: k for k, x in enumerate(names)}
    if langs:
        np.add.at(count, (sums.column("bucket").to_numpy(), np.array([of[x] for x in langs])),
                  sums.column("n").to_numpy())
    return LanguageModel(names, np.log(count / count.sum(axis=0)))


def _em(p, c, row, begin, total, allowed, rounds: int = 15):
    """Mixture proportions of each row over its allowed languages, and the log likelihood."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = p * pi[row]
        joint *= (c / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        pi = np.add.reduceat(joint, begin, axis=0) / total[:, None]
    mass = np.maximum((p * pi[row]).sum(axis=1), 1e-300)
    return pi, np.add.reduceat(c * np.log(mass), begin)


def _most(p, c, row, begin, total, pi, like):
    """A log likelihood that no proportions exceed: it is concave in them, so that the steepest
    slope at ``pi`` bounds what any others can add to ``like``."""
    mass = np.maximum((p * pi[row]).sum(axis=1), 1e-300)
    slope = np.add.reduceat(p * (c / mass)[:, None], begin, axis=0) / total[:, None]
    return like + total * np.log(slope.max(axis=1))


def infer(model: LanguageModel, row, bucket, penalty: float = 3.0):
    """For each row that has trigrams: row, proportions (0 outside the language set), score. A set
    grows by the language of the next largest proportion as long as the penalised likelihood does."""
    n_lang = len(model.languages)
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    of, f = key // BUCKETS, key % BUCKETS
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    rows = of[begin]
    size = np.diff(np.append(begin, len(of)))
    local = np.repeat(np.arange(len(rows)), size)
    c = count / 3.0
    log_p = model.log_p[f]
    single = np.add.reduceat(c[:, None] * log_p, begin, axis=0)
    total = np.add.reduceat(c, begin)
    best = single.argmax(axis=1)
    like = single[np.arange(len(rows)), best]
    share = np.zeros((len(rows), n_lang))
    share[np.arange(len(rows)), best] = 1.0
    score = 1 / np.exp(single - like[:, None]).sum(axis=1)
    if n_lang > 1:
        p = np.exp(log_p)
        full, whole = _em(p, c, local, begin, total, np.ones((len(rows), n_lang)))
        bound = _most(p, c, local, begin, total, full, whole)
        order = np.argsort(-full, axis=1, kind="stable")
        active = np.arange(len(rows))
        for k in range(2, n_lang + 1):
            # Rows that no set of languages could raise by the penalty need not be tried.
            active = active[bound[active] - like[active] > penalty * np.log(3 * total[active] + 1)]
            if not len(active):
                break
            pick = np.isin(local, active)
            sub = np.searchsorted(active, local[pick])
            first = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
            allowed = np.zeros((len(active), n_lang))
            np.put_along_axis(allowed, order[active, :k], 1.0, axis=1)
            pi, new = _em(p[pick], c[pick], sub, first, total[active], allowed)
            won = new - like[active] > penalty * np.log(3 * total[active] + 1)
            active, pi = active[won], pi[won]
            share[active], like[active] = pi, new[won]
            score[active] = pi.max(axis=1)
    return rows, share, score


def _predict(batches, model):
    m: LanguageModel = model.value
    names = np.array([*m.languages, UNKNOWN], object)
    for batch in batches:
        col = text_column(batch)
        lettered = has_letter(col)
        for i, j, buf, offs in text_slices(col):
            n = j - i
            pred = np.full(n, len(m.languages))
            score = np.zeros(n)
            mixture = [""] * n
            row, bucket = trigrams(buf, offs)
            if len(row) and m.languages:
                rows, share, value = infer(m, row, bucket)
                pred[rows], score[rows] = share.argmax(axis=1), value
                for r, s in zip(rows, share):
                    mixture[r] = ",".join(f"{names[k]}:{s[k]:.3f}" for k in np.flatnonzero(s > 0))
            out = ~lettered[i:j]
            pred[out], score[out] = len(m.languages), 0.0
            for r in np.flatnonzero(out):
                mixture[r] = ""
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, n) for k in range(batch.num_columns)),
                 pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0), pa.float64()),
                 pa.array(mixture, pa.string())],
                names=[*batch.schema.names, "lang_pred", "score", "mixture"])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and mixture (``lang:share,...``), which replace
    columns of these names; only the column ``text`` is read, the others are carried along."""
    docs = docs.drop("lang_pred", "score", "mixture")
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda x: _predict(x, shared),
                           f"{schema}, lang_pred string, score double, mixture string")


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that ``predict`` does not call ``und``, with their own columns."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score", "mixture")}
    found = predict(docs.withColumnsRenamed(own), model).where(F.col("lang_pred") != UNKNOWN)
    return found.drop("lang_pred", "score", "mixture").withColumnsRenamed({v: k for k, v in own.items()})
