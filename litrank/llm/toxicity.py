"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its letter n-grams (3 to 5 bytes, blanks at its ends included) and of the
word itself, each hashed to one of BUCKETS vectors. A window of WINDOW words is the average of
its vectors, classified by a softmax; a document is as toxic as its worst window (of
SCORED_WINDOW words), so that a long text does not dilute an insult. An unseen misspelling shares most n-grams with the word
it stands for.

Vectors and softmax are trained together (gradient steps) on a bounded sample of the labelled rows:
at most ``max_positive`` toxic and ``max_negative`` other documents, chosen by a hash of their
id. Labels belong to documents, so training alternates: score all windows, then learn from
the worst windows of each document and some others. A logistic map from the worst window to
the document's label, fitted on the same sample and moved to the share of toxic rows among all
labelled rows, gives the score.

Defined results
    * A null, empty or letterless text has no window: its score is that of a window without
      n-grams, which is below 0.5 unless all training rows are toxic.
    * Rows with null label or null text teach nothing. Without a label of one of the two
      classes every score is 0 (or 1 if all are toxic).
    * Repeated rows are scored each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import hash_share, ship_code
from litrank.llm.text_arrays import byte_span_hashes, gram_codes, letter_runs, mix, text_column, text_slices

BUCKETS = 1 << 18
WINDOW = 16                   # words of a training window
SCORED_WINDOW = 8             # words of a window of a scored document
DIM = 8
LEAST_STEPS = 80              # gradient steps of a round of training, at least
NEGATIVE_WINDOWS = 48        # windows kept of a training document of label 0, about
_U = np.uint64


def subwords(buf: np.ndarray, offsets: np.ndarray):
    """Buckets of all subwords of a slice with the word each is in; row of each word."""
    text, begin = letter_runs(buf, offsets)
    blank = text == 0x20
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    row = np.searchsorted(begin, starts, "right") - 1
    number = np.cumsum(blank[:-1] & ~blank[1:])            # words that began up to the next place
    buckets, words = [], []
    for n in (3, 4, 5):
        if len(text) < n:
            continue
        inner = np.zeros(len(text) - n + 1, bool)
        for k in range(1, n - 1):
            inner |= blank[k:len(text) - n + 1 + k]
        at = np.flatnonzero(~inner)
        code = gram_codes(text, n)[at] | _U(n << 48)
        buckets.append(mix(code) >> _U(46))
        words.append(number[at] - 1)
    if len(starts):                                        # the word itself
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        buckets.append(byte_span_hashes(text, starts, ends) >> _U(46))
        words.append(np.arange(len(starts)))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), row
    return np.concatenate(buckets).astype(np.int64), np.concatenate(words), row


def windows_of(word_row: np.ndarray, rows: int, words: int):
    """Window of each word (numbered over the slice), row of each window, for windows of
    ``words`` words."""
    n = np.bincount(word_row, minlength=rows)
    first = np.cumsum(n) - n
    place = np.arange(len(word_row)) - first[word_row]
    per_row = -(-n // words)
    base = np.cumsum(per_row) - per_row
    return base[word_row] + place // words, np.repeat(np.arange(rows), per_row)


class ToxicityModel:
    """weight: logit of class 1 against 0 for each bucket; bias; slope and shift of the map from
    the worst window's logit to the document's log odds."""

    def __init__(self, weight, bias, slope, shift):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift

    def worst(self, buf, offsets) -> np.ndarray:
        rows = len(offsets) - 1
        bucket, word, word_row = subwords(buf, offsets)
        out = np.full(rows, self.bias, float)
        if len(bucket):
            window, window_row = windows_of(word_row, rows, SCORED_WINDOW)
            at = window[word]
            total = np.bincount(at, self.weight[bucket], len(window_row))
            mean = total / np.bincount(at, minlength=len(window_row)) + self.bias
            out = np.full(rows, -np.inf)
            np.maximum.at(out, window_row, mean)
            out[np.isinf(out)] = self.bias
        return out

    def score(self, buf, offsets) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(buf, offsets) + self.shift, -50, 50)))


class SparseMean:
    """Means of vectors over the subwords of each window of a batch, and their gradient."""

    def __init__(self, window, vector, size):
        self.window, self.vector, self.size = window, vector, size

    def forward(self, vectors):
        return np.stack([np.bincount(self.window, v[self.vector], len(self.size)) / self.size
                         for v in vectors.T.astype(float)], axis=1)

    def backward(self, grad, n):
        return np.stack([np.bincount(self.vector, g[self.window], n) for g in (grad / self.size[:, None]).T], axis=1)


def gradients(bag: SparseMean, vectors, soft, bias, y, share):
    """Gradients, by the vectors, the softmax and its bias, of the sum over windows of ``share``
    times the cross entropy of the window's class ``y``."""
    avg = bag.forward(vectors)
    z = avg @ soft + bias
    z -= z.max(axis=1, keepdims=True)
    err = np.exp(z)
    err /= err.sum(axis=1, keepdims=True)
    err[np.arange(len(y)), y] -= 1
    err *= share[:, None]
    return bag.backward(err @ soft.T, len(vectors)), avg.T @ err, err.sum(axis=0)


def train(texts: list[str], labels: np.ndarray, rounds: int = 10, batch: int = 256, rate: float = 8.0,
          positive_windows: int = 6, seed: int = 7) -> ToxicityModel:
    """Joint training on a sample that is in memory."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, int)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 50.0 if len(labels) and labels[0] else -50.0)
    bucket, counts, owner = [], [], []
    row0 = 0
    for i, j, buf, offs in text_slices(pa.array(texts, pa.string())):
        b, w, word_row = subwords(buf, offs)
        win, win_row = windows_of(word_row, j - i, WINDOW)
        at = win[w] if len(w) else w
        keep = (rng.random(len(win_row)) * np.bincount(win_row, minlength=j - i)[win_row] < NEGATIVE_WINDOWS) | \
            (labels[row0 + win_row] == 1)
        b, at = b[keep[at]].astype(np.int32), (np.cumsum(keep) - 1)[at[keep[at]]]
        order = np.argsort(at, kind="stable")
        bucket.append(b[order])
        counts.append(np.bincount(at, minlength=int(keep.sum())))
        owner.append(win_row[keep] + row0)
        row0 += j - i
    bucket, counts, owner = map(np.concatenate, (bucket, counts, owner))
    base = len(counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    size = np.maximum(counts, 1)

    def logits(weight):
        out = np.zeros(base)
        for lo in range(0, base, 4096):
            part = np.arange(lo, min(base, lo + 4096))
            total = np.concatenate([[0.0], np.cumsum(weight[bucket[begin[lo]:begin[part[-1] + 1]]], dtype=float)])
            out[part] = (total[begin[part + 1] - begin[lo]] - total[begin[part] - begin[lo]]) / size[part]
        return out

    emb = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    for turn in range(rounds):
        weight = emb @ (soft[:, 1] - soft[:, 0])
        value = logits(weight)
        by = np.lexsort((-value, owner))                                    # worst windows first
        rank = np.arange(base) - np.searchsorted(owner[by], owner[by])
        toxic = labels[owner[by]] == 1
        if turn == 0:
            chosen = by
        else:
            chosen = by[np.where(toxic, rank < positive_windows, (rank < 4) | (rng.random(base) < 0.1))]
        share = len(chosen) / (2 * np.maximum(np.bincount(labels[owner[chosen]], minlength=2), 1))
        step = rate * (1 - turn / rounds)
        passes = -(-LEAST_STEPS * batch // len(chosen))                     # a small sample is seen more often
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for s in range(0, len(chosen), batch):
            w = chosen[s:s + batch]
            n = np.diff(begin)[w]
            idx = bucket[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            seg = np.repeat(np.arange(len(w)), n)
            local, inv = np.unique(idx, return_inverse=True)
            bag = SparseMean(seg, inv, size[w])
            y = labels[owner[w]]
            to_vectors, to_soft, to_bias = gradients(bag, emb[local], soft, bias, y, share[y])
            emb[local] -= (step * to_vectors).astype(np.float32)
            soft -= (0.02 * step / len(w) * to_soft).astype(np.float32)
            bias -= (0.02 * step * to_bias / len(w)).astype(np.float32)
    weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    model = ToxicityModel(weight, float(bias[1] - bias[0]), 1.0, 0.0)
    worst = np.concatenate([model.worst(buf, offs) for _, _, buf, offs in text_slices(pa.array(texts, pa.string()))])
    model.slope, model.shift = _logistic(worst, labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic regression with a weak prior, by Newton steps."""
    scale = x.std() or 1.0
    a, b = 0.0, 0.0
    v = (x - x.mean()) / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(v * (y - p)).sum() - 0.05 * a, (y - p).sum() - 0.001 * b])
        h = np.array([[(w * v * v).sum() + 0.05, (w * v).sum()], [(w * v).sum(), w.sum() + 0.001]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b - a * x.mean() / scale


def _train_task(table, rounds: int):
    m = train(table.column("text").to_pylist(), table.column("label").to_numpy(), rounds)
    return pa.table({"weight": pa.array([m.weight.astype("<f4").tobytes()], pa.binary()),
                     "rest": pa.array([[m.bias, m.slope, m.shift]], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 3000,
        rounds: int = 10) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1): at most
    ``max_positive`` rows of label 1 and ``max_negative`` of label 0, chosen by
    hashes of their doc_id. Only their ids are sorted; the sampled texts, bounded in number, are
    trained on in one task."""
    ship_code(docs.sparkSession)
    rows = labels.where("label in (0, 1) AND doc_id is not null") \
        .select("doc_id", F.col("label").cast("int").alias("label"))
    order = [F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("doc_id")]
    toxic, all_rows = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    few = lambda n, total: hash_share(["doc_id"], 2 * n + 100, total)
    ids = rows.where("label = 1").where(few(max_positive, toxic)).orderBy(*order).limit(max_positive) \
        .unionByName(rows.where("label = 0").where(few(max_negative, all_rows - toxic))
                     .orderBy(*order).limit(max_negative))
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").select("text", "label")
    found = sample.groupBy(F.lit(1).alias("one")).applyInArrow(
        lambda table: _train_task(table, rounds), "weight binary, rest array<double>").first()
    if found is None:
        return train([], np.zeros(0, int))
    bias, slope, shift = found["rest"]
    if 0 < toxic < all_rows:      # the sample has more toxic rows than the labelled rows
        shift += np.log(toxic / (all_rows - toxic) * min(max_negative, all_rows - toxic) / min(max_positive, toxic))
    return ToxicityModel(np.frombuffer(found["weight"], "<f4"), bias, slope, shift)


def _score(batches, model):
    m: ToxicityModel = model.value
    for batch in batches:
        col = text_column(batch)
        value = [m.score(buf, offs) for _, _, buf, offs in text_slices(col)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(value) if value else np.zeros(0), pa.float64())],
            names=[*batch.schema.names, "toxicity"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a column toxicity (0 to 1), which replaces one of this name; only ``text`` is
    read."""
    docs = docs.drop("toxicity")
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda x: _score(x, shared), f"{schema}, toxicity double")
