"""Token-id files with keyed access through a minimal perfect hash.

Documents are range-partitioned and sorted by ``doc_id``; each task encodes its range and
writes shards. A shard is one row of the written table: ``first_key`` and ``last_key`` (for
pruning by a reader that looks up keys), ``n_docs``, ``n_ids``, an ``index`` and a ``payload``.

    payload   raw ids, little-endian, 2 bytes each if the vocabulary allows it, else 4
    index     magic, id width, document count, key count, level count; offsets of the
              documents in the payload, their keys and null marks; then the hash: for each
              level its size, its bits and its rank directory, for each key its 32-bit
              fingerprint and the number of its first document, in hash order

The hash is built in levels (Limasset et al. 2017): keys that have a bit of the level to
themselves set it, the others go to the next level; the rank of a key's bit is its slot. The
rank directory has the number of bits set before each block of 512 bits, so that a rank takes
one entry and the counts of at most eight words. A lookup probes about two bits, compares the
fingerprint and slices the payload: constant time, as nothing of the index is unpacked or
copied, and a key that is absent is refused with probability 1 - 2^-32.

Defined results
    * A null or empty text is its end id alone. Documents with a null ``doc_id`` come first;
      they are read back in order but have no key.
    * Documents that repeat a ``doc_id`` are all written, ordered by a hash of their text; a
      lookup returns each. Other columns are ignored. An empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code, shuffle_width
from litrank.llm.text_arrays import mix, text_column
from litrank.llm.token_ids import json_encoder

MAGIC = b"KIX2"
HEAD = "<4sIQQI"
SHARD_IDS = 1 << 21
BLOCK_BITS = 512              # bits to an entry of the rank directory
_U = np.uint64
SHARDS = ("part int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, "
          "index binary, payload binary")


# --- minimal perfect hash ----------------------------------------------------------------------

def _probe(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U((level + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
    return (mix(keys.astype(np.uint64) ^ seed) % _U(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(mix(keys.astype(np.uint64)) + _U(0xA5A5A5A5)) >> _U(32)).astype(np.uint32)


class Level:
    """Bits of one level, in 64-bit words, eight to a block, and the rank of each block: the bits
    set before it, here and in the levels before."""

    def __init__(self, size: int, words: np.ndarray, ranks: np.ndarray):
        self.size, self.words, self.ranks = size, words, ranks

    @staticmethod
    def of(bits: np.ndarray, base: int) -> Level:
        blocks = -(-len(bits) // BLOCK_BITS)
        words = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        words[:-(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        words = words.view("<u8")
        ones = np.bitwise_count(words).reshape(blocks, -1).sum(1, dtype=np.int64)
        return Level(len(bits), words, (base + np.cumsum(ones) - ones).astype("<u8"))

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        block, word = at // BLOCK_BITS, at >> 6
        out = self.ranks[block].astype(np.int64)
        for k in range(BLOCK_BITS // 64 - 1):
            before = block * (BLOCK_BITS // 64) + k
            out += np.where(before < word, np.bitwise_count(self.words[before]), 0)
        below = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return out + np.bitwise_count(self.words[word] & below)


def build_hash(keys: np.ndarray, load: float = 2.0, most_levels: int = 64) -> list[Level]:
    """The levels for distinct ``keys``."""
    levels, left, base = [], keys, 0
    while len(left):
        if len(levels) == most_levels:
            raise ValueError("keys are not distinct")
        size = max(8, int(len(left) * load))
        at = _probe(left, len(levels), size)
        count = np.bincount(at, minlength=size)
        levels.append(Level.of(count == 1, base))
        alone = count[at] == 1
        base += int(alone.sum())
        left = left[~alone]
    return levels


def slots(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, 0 to n - 1; for a foreign key any slot, or -1."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for k, level in enumerate(levels):
        if not len(left):
            break
        at = _probe(keys[left], k, level.size)
        hit = level.has(at)
        out[left[hit]] = level.rank(at[hit])
        left = left[~hit]
    return out


# --- a shard -----------------------------------------------------------------------------------

def write_index(keys: list, sizes: list[int], width: int) -> bytes:
    offsets = np.zeros(len(sizes) + 1, "<u8")
    np.cumsum(sizes, out=offsets[1:])
    null = np.array([k is None for k in keys], bool)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    fresh = ~null & np.append(True, key[1:] != key[:-1])          # keys come in order
    fresh[1:] |= ~null[1:] & null[:-1]
    first = np.flatnonzero(fresh).astype("<u4")
    levels = build_hash(key[first])
    slot = slots(levels, key[first])
    prints, docs = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")
    prints[slot], docs[slot] = fingerprints(key[first]), first
    parts = [struct.pack(HEAD, MAGIC, width, len(sizes), len(first), len(levels)),
             offsets.tobytes(), key.tobytes(), np.packbits(null, bitorder="little").tobytes()]
    for level in levels:
        parts += [struct.pack("<Q", level.size), level.words.tobytes(), level.ranks.tobytes()]
    return b"".join([*parts, prints.tobytes(), docs.tobytes()])


class Shard:
    """Reader of one shard."""

    def __init__(self, index: bytes, payload):
        magic, self.width, self.n_docs, n_keys, n_levels = struct.unpack_from(HEAD, index)
        if magic != MAGIC:
            raise ValueError("not a shard index")
        at = struct.calcsize(HEAD)

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(index, kind, n, at)
            at += out.nbytes
            return out

        def level():
            size = int(take("<u8", 1)[0])
            blocks = -(-size // BLOCK_BITS)
            return Level(size, take("<u8", blocks * BLOCK_BITS // 64), take("<u8", blocks))

        self.offsets = take("<u8", self.n_docs + 1)
        self.keys = take("<i8", self.n_docs)
        self.null_bits = take(np.uint8, -(-self.n_docs // 8))
        self.levels = [level() for _ in range(n_levels)]
        self.prints, self.docs = take("<u4", n_keys), take("<u4", n_keys)
        self.payload = np.frombuffer(payload, f"<u{self.width}")

    @property
    def null(self) -> np.ndarray:
        """Which documents have no key."""
        return np.unpackbits(self.null_bits, count=self.n_docs, bitorder="little").astype(bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 where the shard has none."""
        keys = np.asarray(keys, np.int64)
        slot = slots(self.levels, keys)
        out = np.full(len(keys), -1, np.int64)
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self.prints[slot[ok]] == fingerprints(keys[ok])]
        out[ok] = self.docs[slot[ok]]
        return out

    def ids(self, doc: int) -> np.ndarray:
        return self.payload[int(self.offsets[doc]):int(self.offsets[doc + 1])].astype("<u4")

    def lookup(self, key: int) -> list[np.ndarray]:
        doc = int(self.find(np.array([key]))[0])
        out = []
        while 0 <= doc < self.n_docs and self.keys[doc] == key and not self.null_bits[doc >> 3] >> (doc & 7) & 1:
            out.append(self.ids(doc))
            doc += 1
        return out


# --- the jobs ----------------------------------------------------------------------------------

def _encode(batches, path: str, end_id: int, width: int, shard_ids: int):
    encoder, part, seq = json_encoder(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], f"<u{width}")
    keys, sizes, ids, held = [], [], [], 0

    def shard():
        known = [k for k in keys if k is not None]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
            "first_key": pa.array([known[0] if known else None], pa.int64()),
            "last_key": pa.array([known[-1] if known else None], pa.int64()),
            "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([held], pa.int64()),
            "index": pa.array([write_index(keys, sizes, width)], pa.binary()),
            "payload": pa.array([np.concatenate(ids).tobytes()], pa.binary())})

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for i, j, found, offs in encoder.slices(text_column(batch)):
            found = found.astype(f"<u{width}")
            for k in range(j - i):
                one = found[offs[k]:offs[k + 1]]
                keys.append(docs[i + k])
                sizes.append(len(one) + 1)
                ids += [one, end]
                held += len(one) + 1
                if held >= shard_ids:
                    yield shard()
                    keys, sizes, ids, held, seq = [], [], [], 0, seq + 1
    if keys:
        yield shard()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Write the ids of all documents, in ascending ``doc_id`` order, below ``path``."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    ship_code(spark)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions or shuffle_width(spark), *order).sortWithinPartitions(*order)
    rows.mapInArrow(lambda x: _encode(x, tokenizer, end_id, width, shard_ids), SHARDS) \
        .write.option("compression", "zstd").parquet(path)


def _read(batches):
    for batch in batches:
        at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            s = Shard(at["index"][r], at["payload"][r])
            null = s.null
            first = np.flatnonzero(~null & np.append(True, (s.keys[1:] != s.keys[:-1]) | null[:-1]))
            if not (s.find(s.keys[first]) == first).all():
                raise ValueError("a key is not found where its document is")
            ids = [s.ids(k) for k in range(s.n_docs)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([at["part"][r]] * s.n_docs, pa.int32()),
                "seq": pa.array([at["seq"][r]] * s.n_docs, pa.int32()),
                "doc_id": pa.array(s.keys, pa.int64(), mask=null),
                "local": pa.array(s.offsets[:-1].astype(np.int64), pa.int64()),
                "n_tokens": pa.array(np.diff(s.offsets).astype(np.int64), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())})


def read_token_files(spark, path: str) -> DataFrame:
    """Every document of the files, each reached through the hash of its shard: doc_id, start
    (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    ship_code(spark)
    shards = spark.read.parquet(path)
    docs = shards.select("part", "seq", "index", "payload").mapInArrow(
        _read, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")) \
        .join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _find(batches, keys):
    for batch in batches:
        out_k, out_i = [], []
        for index, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = Shard(index, payload)
            for key in keys:
                for ids in s.lookup(key):
                    out_k.append(key)
                    out_i.append(ids.tolist())
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out_k, pa.int64()),
                                          "ids": pa.array(out_i, pa.list_(pa.int64()))})


def lookup_keys(spark, path: str, keys: list[int]) -> DataFrame:
    """The documents of a few keys: (doc_id, ids). Only shards whose key range holds one of
    the keys are read."""
    ship_code(spark)
    wanted = F.lit(False)
    for k in keys:
        wanted = wanted | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
    return spark.read.parquet(path).where(wanted).select("index", "payload") \
        .mapInArrow(lambda x: _find(x, keys), "doc_id bigint, ids array<bigint>")
