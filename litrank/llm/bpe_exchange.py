"""Byte-level BPE encoding by a global exchange of distinct words, and decoding.

1. Texts are exploded to pre-tokens with positions. A chunk (CHUNK_BYTES of text of one task)
   lists its distinct pre-tokens once, cut by hash into parts, and keeps the positions as a
   sequence of codes into that list.
2. Words are shuffled by part. There each distinct word of the corpus is encoded once, by the
   merge ranks, and every chunk gets the ids of its words back in their order.
3. Ids are joined to the chunk's positions by chunk key; each text is reassembled by position.
4. Decoding joins ids with the token-byte table (one row for each id of the rank file, so its
   size is that of the vocabulary) and concatenates the bytes.

Nothing that moves is a row per occurrence: a frequent word is one entry for each chunk.

Defined results
    * A null text is the empty text: no ids, no bytes. A null ``doc_id`` stays null.
    * Repeated rows are encoded each. Other columns are ignored; an empty table gives no rows.
    * Special tokens are not recognised: their names are encoded as ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.packed import pack, unpack
from litrank.llm.stages import ship_code, shuffle_width, stored_buckets
from litrank.llm.text_arrays import code_point_hashes, pretoken_starts, text_column, text_rows

CHUNK_BYTES = 2 << 20
_U = np.uint64

CHUNKS = "chunk bigint, part int, words binary, docs binary, codes binary"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()),
                     ("docs", pa.binary()), ("codes", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODERS: dict = {}


def rank_encoder(path: str, pattern: str):
    if path not in _ENCODERS:
        import tiktoken
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path),
                                            special_tokens={})
    return _ENCODERS[path]


# --- 1: chunks ---------------------------------------------------------------------------------

def _explode(batches, parts: int):
    number = TaskContext.get().partitionId() << 32
    held: list = []           # (ids, hashes, pre-token counts) of the slices of the chunk
    words: dict = {}
    size = 0

    def chunk():
        hashes = np.concatenate([h for _, h, _ in held])
        names, code, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")             # frequent words get small codes
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        part = (names[order] >> _U(32)) % _U(parts)
        docs = [d for ids, _, _ in held for d in ids]
        counts = np.concatenate([c for _, _, c in held])
        null = np.array([d is None for d in docs], np.uint8)
        key = np.array([0 if d is None else d for d in docs], np.int64).view(np.uint64)
        rows = {"chunk": [number], "part": [-1], "words": [None], "docs": [pack(key, null, counts)],
                "codes": [pack(rank[code], part)]}
        for p in np.unique(part):
            mine = [words[int(h)].encode() for h in names[order][part == p]]
            blob = np.fromiter(map(len, mine), np.int64, len(mine))
            rows["chunk"].append(number)
            rows["part"].append(int(p))
            rows["words"].append(pack(blob, np.frombuffer(b"".join(mine), np.uint8)))
            rows["docs"].append(None)
            rows["codes"].append(None)
        return pa.RecordBatch.from_pydict(rows, schema=_CHUNKS)

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for i, j, text, cp, offs in text_rows(text_column(batch)):
            starts = pretoken_starts(cp, offs)
            ends = np.append(starts[1:], len(cp)) if len(starts) else starts
            hashes = code_point_hashes(cp, starts, ends)
            for h, k in zip(*(v.tolist() for v in np.unique(hashes, return_index=True))):
                if h not in words:
                    words[h] = text[starts[k]:ends[k]]
            held.append((docs[i:j], hashes, np.diff(np.searchsorted(starts, offs))))
            size += len(text)
            if size >= CHUNK_BYTES:
                yield chunk()
                held, words, size, number = [], {}, 0, number + 1
    if held:
        yield chunk()


# --- 2: words ----------------------------------------------------------------------------------

def _words(blob: bytes) -> list[bytes]:
    size, flat = unpack(blob)
    raw, end = flat.astype(np.uint8).tobytes(), np.cumsum(size).tolist()
    return [raw[a:b] for a, b in zip([0, *end], end)]


def _encode_part(table, path: str, pattern: str):
    encoder = rank_encoder(path, pattern)
    ids: dict[bytes, list[int]] = {}
    replies = []
    for blob in table.column("words").to_pylist():
        mine = _words(blob)
        for w in mine:
            if w not in ids:
                ids[w] = encoder.encode_ordinary(w.decode())
        found = [ids[w] for w in mine]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(size.sum()))
        replies.append(pack(size, flat))
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"),
                     "words": pa.array(replies, pa.binary())})


# --- 3: positions ------------------------------------------------------------------------------

def _assemble(main, replies):
    key, null, counts = unpack(main.column("docs")[0].as_py())
    code, of_part = unpack(main.column("codes")[0].as_py())
    size = np.zeros(len(of_part), np.int64)
    begin = np.zeros(len(of_part), np.int64)
    pool, base = [], 0
    for p, blob in zip(replies.column("part").to_pylist(), replies.column("words").to_pylist()):
        n, flat = unpack(blob)
        mine = np.flatnonzero(of_part == p)
        size[mine] = n
        begin[mine] = base + np.cumsum(n) - n
        pool.append(flat.astype("<u4"))
        base += len(flat)
    pool = np.concatenate(pool) if pool else np.zeros(0, "<u4")
    n = size[code]
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    ids = pool[np.repeat(begin[code] - total[:-1], n) + np.arange(total[-1])]
    ends = total[np.cumsum(counts)].tolist() if len(counts) else []
    return pa.table({"doc_id": pa.array(key.view(np.int64), pa.int64(), mask=null.astype(bool)),
                     "ids": pa.array([ids[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())})


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every document: ids as unsigned 32-bit little-endian integers.
    ``ranks`` is a rank file of the tiktoken library, ``pattern`` its splitting pattern (the
    split itself is that of ``text_arrays.pretoken_starts``)."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = shuffle_width(spark)
    chunks = stored_buckets(rows.mapInArrow(lambda x: _explode(x, parts), CHUNKS), "bpe_chunks", "chunk")
    replies = chunks.where("part >= 0").select("chunk", "part", "words").groupBy("part") \
        .applyInArrow(lambda table: _encode_part(table, ranks, pattern), "chunk bigint, part int, words binary")
    # The chunks lie in buckets: only the replies move to them.
    positions = chunks.where("part < 0").select("chunk", "docs", "codes")
    return positions.groupBy("chunk").cogroup(replies.groupBy("chunk")) \
        .applyInArrow(lambda main, found: _assemble(main, found), "doc_id bigint, ids binary")


# --- 4: decoding -------------------------------------------------------------------------------

_TABLES: dict = {}


def _token_bytes(path: str):
    """The token-byte table: begin and size of the bytes of each id, and the bytes."""
    if path not in _TABLES:
        by_id = {i: b for b, i in read_ranks(path).items()}
        rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        _TABLES[path] = np.cumsum(size) - size, size, np.frombuffer(b"".join(rows), np.uint8)
    return _TABLES[path]


def _decode(batches, path: str):
    begin, size, pool = _token_bytes(path)
    for batch in batches:
        ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
        out = []
        for one in ids:
            n = size[one]
            at = np.cumsum(n) - n
            out.append(pool[np.repeat(begin[one] - at, n) + np.arange(int(n.sum()))].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                         names=["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids stand for."""
    ship_code(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda x: _decode(x, ranks), "doc_id bigint, ids binary, decoded binary")
