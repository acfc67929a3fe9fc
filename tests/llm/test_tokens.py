"""Encoding, packing and token files against the tokenizer libraries."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pyarrow as pa

from litrank.llm import bpe_exchange, packing, text_arrays, token_files, token_ids

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PIECES = st.sampled_from(list("ab'srevltmd  \n\t1!.é²　 日") + ["'s", "'re", " '", "'ll", "the ", "<|endoftext|>"])


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_pretokens_are_those_of_the_pattern(texts):
    rx = regex.compile(P.PATTERN)
    for i, j, text, cp, offs in text_arrays.text_rows(pa.array(texts, pa.string()), 24):
        starts = [*text_arrays.pretoken_starts(cp, offs).tolist(), len(cp)]
        assert [text[a:b] for a, b in zip(starts, starts[1:])] == [w for t in texts[i:j] for w in rx.findall(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_encoder_with_a_tiny_cache(texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    encoder = token_ids.TextEncoder(token_ids.json_word_encoder(JSON), limit=5)
    got = [ids[offs[k]:offs[k + 1]].tolist() for i, j, ids, offs in encoder.slices(pa.array(texts, pa.string()))
           for k in range(j - i)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endof", "text|> y", "é <|endoftext|>\n日",
         None, "", "  <|endoftext|>  's", "<|endoftext|"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_encoder_finds_added_tokens(texts):
    t = Tokenizer.from_file(JSON)
    texts = texts + [x or "" for x in ADDED]
    encoder = token_ids.TextEncoder(token_ids.json_word_encoder(JSON), limit=5, added=token_ids.added_tokens(JSON))
    got = [ids[offs[k]:offs[k + 1]].tolist() for i, j, ids, offs in encoder.slices(pa.array(texts, pa.string()))
           for k in range(j - i)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_in_packing_and_files(spark, tmp_path):
    t = Tokenizer.from_file(JSON)
    want = {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(ADDED)}
    assert any(50256 in ids for ids in want.values())
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id bigint, text string")
    pieces = defaultdict(bytes)
    for r in sorted(packing.pack_documents(docs, JSON, window=64).collect(), key=lambda r: r.start):
        pieces[r.doc_id] += bytes(r.ids)
    assert {k: np.frombuffer(b, "<u4").tolist()[:-1] for k, b in pieces.items()} == want
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, JSON)
    assert {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, path).collect()} == \
        {k: len(ids) + 1 for k, ids in want.items()}


def test_exchange_round_trip(odd_docs, no_docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_exchange.read_ranks(RANKS), special_tokens={})
    got = bpe_exchange.decode(bpe_exchange.encode(odd_docs, RANKS, P.PATTERN), RANKS).collect()
    want = [(str(r.doc_id), tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd_docs.collect()]
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == sorted(want)
    assert bpe_exchange.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_exchange_of_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [bytes(r.ids) for r in bpe_exchange.encode(docs, RANKS, P.PATTERN).collect()] == [b"", b""]


def check_pieces(rows, docs, window, encode):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[str(r.doc_id), r.doc_tokens].append((r.start, r.length, r.ids))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == window or at & (at - 1) == 0
    # ids of all documents, as a multiset of (doc_id, ids)
    want = sorted((str(r.doc_id), tuple(encode(r.text)) + (1,)) for r in docs)
    got, starts = [], defaultdict(dict)
    for (d, n), parts in by_doc.items():
        copies = sum(1 for s, _, _ in parts if s == 0)
        assert sum(k for _, k, _ in parts) == copies * n
        if copies == 1:
            ids = b"".join(bytes(b) for _, _, b in sorted(parts, key=lambda p: p[0]))
            got.append((d, tuple(np.frombuffer(ids, "<u4").tolist())))
    once = [w for w in want if sum((w[0], len(w[1])) == (x[0], len(x[1])) for x in want) == 1]
    assert sorted(g for g in got if g in set(once)) == once
    return sum(len(w[1]) for w in want)


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(odd_docs, no_docs, whole, window):
    rows = packing.pack_documents(odd_docs, JSON, window=window).collect()
    total = check_pieces(rows, odd_docs.collect(), window, whole)
    assert sum(r.length for r in rows) == total
    assert packing.pack_documents(no_docs, JSON).count() == 0


def test_sum_of_squares_places_like_the_definition():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquaresPacker(32, 0)
    level = np.zeros(33, int)
    for k in range(400):
        n = int(rng.integers(1, 32))
        costs = {}
        for h in range(0, 33 - n):
            if h and not level[h]:
                continue
            after = level.copy()
            after[h] -= h > 0
            if h + n < 32:
                after[h + n] += 1
            costs[h] = int((after[1:32] ** 2).sum())
        best = max(h for h, c in costs.items() if c == min(costs.values()))
        level[best] -= best > 0
        if best + n < 32:
            level[best + n] += 1
        packer.add(k, np.zeros(n, "<u4"))
        assert (packer.level[1:32] == level[1:32]).all()
    packer.finish()
    assert not packer.open and packer.level.sum() == 0


def test_token_files(spark, odd_docs, no_docs, whole, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd_docs, path, JSON, shard_ids=500, partitions=4)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    docs = odd_docs.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == \
        sorted((str(d.doc_id), len(whole(d.text)) + 1, crc([*whole(d.text), 0])) for d in docs)
    found = token_files.lookup_keys(spark, path, [5, 303, 999]).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted(
        (d.doc_id, (*whole(d.text), 0)) for d in docs if d.doc_id in (5, 303))
    empty = str(tmp_path / "none")
    token_files.write_token_files(no_docs, empty, JSON)
    assert token_files.read_token_files(spark, empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-2 ** 63, 2 ** 63 - 1), max_size=300))
def test_minimal_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    slot = token_files.slots(token_files.build_hash(keys), keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("size", [8, 63, 64, 511, 512, 513, 5000])
def test_rank_directory_counts_the_bits_before(size):
    bits = np.random.default_rng(size).random(size) < 0.4
    level = token_files.Level.of(bits, 17)
    at = np.arange(size)
    assert (level.has(at) == bits).all()
    assert (level.rank(at) == 17 + np.cumsum(bits) - bits).all()


def test_lookup_unpacks_nothing():
    n = 50_000
    keys = [None, None, *range(-5, n, 3)]
    keys += [keys[-1]] * 2                                       # one key with three documents
    ids = np.arange(len(keys), dtype="<u4")
    index, payload = token_files.write_index(keys, [1] * len(keys), 4), ids.tobytes()
    shard = token_files.Shard(index, payload)
    views = [shard.offsets, shard.keys, shard.null_bits, shard.prints, shard.docs, shard.payload,
             *(a for level in shard.levels for a in (level.words, level.ranks))]
    assert all(v.base is not None and not v.flags.owndata for v in views)      # views of the bytes read
    assert [x.tolist() for x in shard.lookup(-5)] == [[2]]
    assert [x.tolist() for x in shard.lookup(keys[-1])] == [[k] for k in range(len(keys) - 3, len(keys))]
    assert shard.lookup(-4) == [] and shard.lookup(0) == []      # a null key is no 0
