"""Language mixture, toxicity, personal data and suffix tree."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litrank.llm import language_mixture, pii_crf, suffix_tree, text_arrays, toxicity

EN = "the and of to in that is was he for it with as his on be at by had not are but from or have".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split()
ES = "de la que el en y a los se del las un por con no una su para es al lo como más".split()


def sentence(rng, words, n=30):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def language_model(spark):
    rng = random.Random(1)
    rows = [(sentence(rng, w), name) for w, name in ((EN, "en"), (DE, "de"), (ES, "es")) for _ in range(60)]
    return language_mixture.fit(spark.createDataFrame([*rows, (None, "fr"), ("chose", None)], "text string, lang string"))


def test_language_predictions(spark, language_model):
    rng = random.Random(2)
    rows = [(k, sentence(rng, w), name) for k, (w, name) in enumerate(((EN, "en"), (DE, "de"), (ES, "es")) * 20)]
    rows += [(90, None, "und"), (91, "", "und"), (92, "12 !! 3", "und"), (93, "THE", "en"), (94, "日本 日本", "?")]
    rows += [(95, sentence(rng, EN, 90) + " " + sentence(rng, DE, 60), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in language_mixture.predict(docs, language_model).collect()}
    assert language_model.languages == ["de", "en", "es"]
    assert all(got[i].lang_pred == name for i, _, name in rows if name != "?") and got[94].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    shares = dict(x.split(":") for x in got[95].mixture.split(","))
    assert set(shares) == {"en", "de"} and abs(float(shares["en"]) - 0.6) < 0.1
    assert {r.doc_id for r in language_mixture.identified(docs, language_model).collect()} == set(got) - {90, 91, 92}


def test_language_without_training(spark, odd_docs, no_docs):
    model = language_mixture.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in language_mixture.predict(odd_docs, model).collect()} == {("und", 0.0)}
    assert language_mixture.predict(no_docs, language_mixture.fit(odd_docs)).count() == 0


def test_language_em_is_plain_em(language_model):
    """The batched estimation against a loop over one text."""
    text = np.frombuffer("the und der is auf with das".encode(), np.uint8)
    row, bucket = language_mixture.trigrams(text, np.array([0, len(text)]))
    pi = np.full(3, 1 / 3)
    p = np.exp(language_model.log_p)
    for _ in range(15):
        resp = np.array([p[b] * pi / (p[b] * pi).sum() for b in bucket])
        pi = resp.mean(axis=0)
    names, count = np.unique(bucket, return_counts=True)
    got, _ = language_mixture._em(p[names], count / 3.0, np.zeros(len(names), int), np.array([0]),
                                  np.array([count.sum() / 3.0]), np.ones((1, 3)))
    assert np.allclose(got[0], pi)


def test_language_sets_of_more_than_three():
    """Proportions of a text in five languages of six, one of them with little of it."""
    rng = random.Random(4)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)]
             for k in range(6)}

    def grams(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return language_mixture.trigrams(buf, np.array([0, len(buf)]))

    count = np.full((language_mixture.BUCKETS, 6), 0.5)
    for k, w in enumerate(words.values()):
        np.add.at(count[:, k], grams(sentence(rng, w, 4000))[1], 1)
    model = language_mixture.LanguageModel(sorted(words), np.log(count / count.sum(axis=0)))
    want = {"l0": 0.395, "l1": 0.25, "l2": 0.2, "l3": 0.14, "l4": 0.015}
    text = " ".join(sentence(rng, words[x], round(4000 * share)) for x, share in want.items())
    _, share, score = language_mixture.infer(model, *grams(text))
    assert np.allclose(share[0], [*want.values(), 0], atol=0.01) and abs(score[0] - 0.395) < 0.01
    assert (share[0] > 0).tolist() == [True] * 5 + [False]


def toxic_rows(rng, n, first):
    bad = ["idiot", "stupid", "moron", "scum", "pathetic"]
    rows = []
    for k in range(n):
        words = sentence(rng, EN, rng.randint(5, 150)).split()
        label = int(rng.random() < 0.3)
        for _ in range(2 * label):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((first + k, " ".join(words), label))
    return rows


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(3)
    train, test = toxic_rows(rng, 500, 0), toxic_rows(rng, 200, 1000)
    test += [(5000, "he was by the idi0t and the stupiid man", 1), (5001, None, 0), (5002, "", 0), (5003, "12 34", 0)]
    docs = spark.createDataFrame([r[:2] for r in train + test], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, lab) for i, _, lab in train] + [(None, 1), (1, None)], "doc_id bigint, label int")
    model = toxicity.fit(docs, labels, max_positive=100, max_negative=200)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.withColumn("toxicity", F.lit("x")), model).collect()}
    hits = [(got[i] >= 0.5) == bool(lab) for i, _, lab in test if i < 5000]
    assert sum(hits) >= 0.97 * len(hits)
    assert got[5000] > max(got[5001], got[5002], got[5003]) and max(got[5001], got[5002], got[5003]) < 0.5
    assert all(0 <= v <= 1 for v in got.values())
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0


def test_worst_window_by_brute_force():
    """The forward pass, one gram after another, on words of a to z."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(n))
             for n in (1, 3, toxicity.SCORED_WINDOW, toxicity.SCORED_WINDOW + 1, 60)] + ["", "12 34"]
    weight = np.random.default_rng(8).standard_normal(toxicity.BUCKETS).astype(np.float32)
    model = toxicity.ToxicityModel(weight, 0.25, 1.0, 0.0)

    def bucket(gram):
        code = text_arrays.gram_codes(np.frombuffer(gram.encode(), np.uint8), len(gram))[:1]
        return int((text_arrays.mix(code | np.uint64(len(gram) << 48)) >> np.uint64(46))[0])

    def word_bucket(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return int((text_arrays.byte_span_hashes(b, np.array([0]), np.array([len(b)])) >> np.uint64(46))[0])

    want = []
    for t in texts:
        words = re.findall("[a-z]+", t)
        means = []
        for k in range(0, len(words), toxicity.SCORED_WINDOW):
            bag = []
            for w in words[k:k + toxicity.SCORED_WINDOW]:
                padded = f" {w} "
                bag += [bucket(padded[i:i + n]) for n in (3, 4, 5) for i in range(len(padded) - n + 1)] + [word_bucket(w)]
            means.append(sum(float(weight[b]) for b in bag) / len(bag) + 0.25)
        want.append(max(means, default=0.25))
    got = np.concatenate([model.worst(buf, offs) for _, _, buf, offs in text_arrays.text_slices(pa.array(texts, pa.string()))])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_gradients_by_differences():
    rng = np.random.default_rng(9)
    window, vector = np.repeat(np.arange(5), 4), rng.integers(0, 7, 20)
    bag = toxicity.SparseMean(window, vector, np.full(5, 4))
    vectors, soft, bias = rng.standard_normal((7, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)
    y, share = np.array([0, 1, 1, 0, 1]), rng.random(5) + 0.5

    def loss():
        total = 0.0
        for k in range(5):
            mean = sum(vectors[v] for v in vector[window == k]) / 4
            z = [float(mean @ soft[:, c] + bias[c]) for c in (0, 1)]
            total += share[k] * (math.log(math.exp(z[0]) + math.exp(z[1])) - z[y[k]])
        return total

    found = toxicity.gradients(bag, vectors, soft, bias, y, share)
    for param, grad in zip((vectors, soft, bias), found):
        for at in np.ndindex(param.shape):
            old = param[at]
            param[at] = old + 1e-5
            up = loss()
            param[at] = old - 1e-5
            down = loss()
            param[at] = old
            assert math.isclose((up - down) / 2e-5, grad[at], rel_tol=1e-5, abs_tol=1e-7)


def test_toxicity_of_one_class(spark, no_docs):
    docs = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id bigint, text string")
    for label, value in ((0, 0), (1, 1)):
        model = toxicity.fit(docs, docs.select("doc_id", F.lit(label).alias("label")))
        assert all(round(r.toxicity) == value for r in toxicity.score(docs, model).collect())
    nothing = toxicity.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("label")))
    assert all(r.toxicity < 0.5 for r in toxicity.score(docs, nothing).collect())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_rules(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii_crf.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


def test_base_rules():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("ab1129.@+-() 0_%é") for _ in range(rng.randint(0, 30)))
        assert pii_crf.base_spans(t) == plain_rules(t)
    assert [k for _, _, k in pii_crf.base_spans("x 4539578763621486 y")] == ["card"]
    assert pii_crf.base_spans("1" * 50000 + "@" * 1000) == []


CARD_A, CARD_B = "4539578763621486", "6011000990139424"


@pytest.fixture(scope="module")
def pii_docs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        w = sentence(rng, EN, 12).split()
        w.insert(6, rng.choice([f"a{k}@mail{k % 9}.example.com", f"10.{k % 256}.3.{k % 200}", CARD_A, CARD_B,
                                f"+1 ({100 + k}) 555-{1000 + k}", f'token = "{rng.getrandbits(160):040x}a1"', str(k), "3.5%"]))
        rows.append((k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, f"cards {CARD_A} {CARD_B} here"), (None, "mail b@c.example.org"),
             (903, "9 " * 3000), (904, "@" * 500)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1))


def test_semi_markov_field(pii_docs, no_docs):
    field = pii_crf.fit(pii_docs)
    got = {r.doc_id: r for r in pii_crf.find_spans(pii_docs, field).collect()}
    for r in pii_docs.collect():
        base = plain_rules(r.text or "")
        row = got[r.doc_id]
        assert row.base_spans == pii_crf.describe(base)
        assert [row[f"n_{k}"] for k in pii_crf.BASE] == [sum(s[2] == k for s in base) for k in pii_crf.BASE]
        assert set(filter(None, row.base_spans.split(","))) <= set(filter(None, row.spans.split(",")))
    assert got[902].spans == f"card:6:{6 + 16},card:{6 + 17}:{6 + 33}"
    assert got[None].spans == "email:5:20" and got[900].spans == got[901].spans == ""
    assert pii_crf.find_spans(no_docs, field).count() == 0
    clean = {r.doc_id: r.text for r in pii_crf.redact(pii_docs, field).collect()}
    assert clean[902] == "cards [CARD] [CARD] here" and clean[900] is None
    assert not any(CARD_A in (t or "") or "@mail" in (t or "") for t in clean.values())


def test_segmentation_is_the_best_of_all():
    """Dynamic programming against all segmentations of a short region."""
    text = f"{CARD_A} {CARD_B} 10.2.3.4"
    field = pii_crf.SemiMarkovField({"card": 1.0, "card:luhn=True": 2.0, "ip": 0.5, "ip:before=s": 0.25, "phone": -1.0})
    bounds, found = pii_crf.candidates(text, (0, len(text)))
    score = field._scores(found)

    def best(i):
        if i == len(bounds) - 1:
            return 0.0, []
        options = [best(i + 1)]
        for k, (a, b, kind, _) in enumerate(found):
            if a == i:
                v, rest = best(b)
                options.append((v + score[k], [(bounds[a], bounds[b], kind), *rest]))
        return max(options, key=lambda o: o[0])

    assert field.best(text, (0, len(text))) == best(0)[1]
    # the gradient is that of the log likelihood
    gold = {k for k, (a, b, kind, _) in enumerate(found) if (bounds[a], bounds[b], kind) in best(0)[1]}
    diff = field._gradient(len(bounds) - 1, found, score, gold)
    assert all(-1 <= d <= 1 for d in diff) and all(diff[k] >= 0 for k in gold)


def symbol_stream(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
    return b"\0" * 4 + b"".join(w.encode().replace(b"\0", b"\1") + b" " for w in words) + b"\0", [*words, None]


def plain_tree(texts, strength=8.0, least_gain=20.0, least_divergence=0.005):
    """Counts, divergence tests and smoothing of a suffix tree in plain Python: (probability, retained contexts)."""
    count = collections.defaultdict(collections.Counter)
    for t in texts:
        stream, _ = symbol_stream(t)
        for k in range(4, len(stream)):
            for d in range(5):
                count[stream[k - d:k]][stream[k]] += 1
    total = {c: sum(v.values()) for c, v in count.items()}

    def p(context, symbol):
        if not context:
            return (count[b""][symbol] + 0.5) / (total.get(b"", 0) + 128)
        n = count[context][symbol] if context in total else 0
        return (n + strength * p(context[1:], symbol)) / (total.get(context, 0) + strength)

    kept = {}
    for c in [c for c in total if c]:
        kl = sum(v / total[c] * math.log(v / total[c] / p(c[1:], s)) for s, v in count[c].items())
        if kl > least_divergence and total[c] * kl > least_gain:
            kept[c] = (total[c], kl)
    return p, kept


def plain_score(stream, p, kept):
    total = 0.0
    for k in range(4, len(stream)):
        d = next((d for d in range(4, 0, -1) if stream[k - d:k] in kept), 0)
        total += math.log10(p(stream[k - d:k], stream[k]))
    return total


def context_bytes(number, depth):
    return int(number).to_bytes(depth, "big")


def test_suffix_tree_and_word_scores(spark, odd_docs):
    """States by their tests, scores by the longest retained suffix, and unigram scores, against plain Python."""
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 400").withColumn("learn", F.col("doc_id") % 3 != 0)
    rows = [(r.doc_id, r.text or "", bool(r.learn)) for r in docs.collect()]
    tree = suffix_tree.fit(docs.where("learn"))
    p, kept = plain_tree([t for _, t, learn in rows if learn])
    states = {context_bytes(r.context, r.depth): (r.n, r.kl) for r in tree.states().collect()}
    assert set(states) == {c for c in kept if len(c) > 1} and len(states) > 50
    assert all(states[c][0] == kept[c][0] and math.isclose(states[c][1], kept[c][1], rel_tol=1e-9) for c in states)
    assert set(np.flatnonzero(tree.kept)) == {c[0] for c in kept if len(c) == 1}
    got = collections.defaultdict(list)
    for r in suffix_tree.score(docs, tree).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    tokens = [symbol_stream(t)[1] for _, t, _ in rows]
    count = collections.Counter(w for (_, _, learn), ws in zip(rows, tokens) if learn for w in ws)
    n, v = sum(count.values()), len(count)
    for (i, t, _), ws in zip(rows, tokens):
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        total = plain_score(symbol_stream(t)[0], p, kept)
        assert any(r.n_tokens == len(ws) and r.n_known == sum(count[w] > 0 for w in ws) and r.train_tokens == n
                   and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, total, rel_tol=1e-6)
                   for r in got[i]), i


def test_a_small_language_keeps_its_contexts(spark):
    """The contexts of a language are those it has alone, where it is a hundredth of the text."""
    rng = random.Random(7)
    small = [(sentence(rng, ["żółw", "źdźbło", "ćma", "łąka", "jeż"], 30),) for _ in range(12)]
    large = [(sentence(rng, EN, 100),) for _ in range(400)]
    alone, both = (suffix_tree.fit(spark.createDataFrame(t, "text string")) for t in (small, small + large))
    own = {context_bytes(r.context, r.depth) for r in alone.states().collect()}
    own = {c for c in own if any(b >= 0x80 for b in c)}
    mixed = {context_bytes(r.context, r.depth) for r in both.states().collect()}
    assert len(own) > 10 and len(own & mixed) >= 0.9 * len(own)


def test_scores_do_not_depend_on_chunks_or_parts(spark, odd_docs, monkeypatch):
    docs = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 5").withColumn("learn", F.lit(True))
    tree = suffix_tree.fit(docs)
    want = sorted(map(tuple, suffix_tree.score(docs, tree).collect()))
    monkeypatch.setattr(suffix_tree, "PART_BYTES", 5000)
    assert sorted(map(tuple, suffix_tree.score(docs.repartition(7), tree).collect())) == want


def test_suffix_tree_learns(spark, no_docs):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, sentence(rng, EN, 40), k < 150) for k in range(200)] +
                                 [(1000, "zqx jkq wvz " * 13, False)], "doc_id bigint, text string, learn boolean")
    tree = suffix_tree.fit(docs.where("learn"))
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, tree).collect()}
    flat = {r.doc_id: r.score for r in suffix_tree.score(docs, suffix_tree.fit(docs.where("false"))).collect()}
    assert all(got[k] > 0.5 * flat[k] for k in range(150, 200)) and got[1000] < min(got[k] for k in range(150, 200))
    assert math.isclose(flat[1000], -math.log10(256) * (len("zqx jkq wvz " * 13) + 1), rel_tol=1e-5)
    assert suffix_tree.score(no_docs, tree).count() == 0
