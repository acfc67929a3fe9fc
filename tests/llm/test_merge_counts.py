import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from litrank.llm.merge_counts import TokenCounter, count_tokens, merge_batch, merge_long, merge_table
from litrank.llm.token_ids import added_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_rows_equal_the_library(odd_docs):
    rows = count_tokens(odd_docs, PATH).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    want = sorted((str(d.doc_id), len((d.text or "").encode()), n, n > 512)
                  for d, n in zip(docs, library([d.text or "" for d in docs])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want


def test_empty_table(no_docs):
    assert count_tokens(no_docs, PATH).collect() == []


def test_added_tokens_overlapping_runs_and_long_words():
    rng = random.Random(4)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "|><|", "aaaaaaa", "x" * 5000,
             " " * 9000, "ab" * 4000, "don't we'll 12 34\n\n\t x", "".join(rng.choice("abé日\n \U0001F600") for _ in range(9000)),
             "".join(rng.choice("abcde") for _ in range(30000))]
    counter = TokenCounter(merge_table(PATH), added_tokens(PATH))
    assert counter.column(pa.array(texts)).tolist() == library(texts)


def test_small_cache_and_both_ways_of_merging_agree():
    rng = np.random.default_rng(1)
    table = merge_table(PATH)
    words = [rng.integers(97, 102, n, dtype=np.uint8) for n in rng.integers(2, 60, 300)]
    got = merge_batch(table, table.first[np.concatenate(words)], np.array([len(w) for w in words]))
    assert got.tolist() == [merge_long(table, table.first[w]) for w in words]
    texts = [" ".join(w.tobytes().decode() for w in words[i:i + 30]) for i in range(0, 300, 30)] * 3
    small = TokenCounter(table, words=50)
    assert small.column(pa.array(texts)).tolist() == library(texts)
    assert len(small.known) <= 50
