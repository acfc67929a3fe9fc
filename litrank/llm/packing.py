"""Sum-of-squares online packing of token ids into training windows.

Each task packs the documents it reads, in order. The ids of a document, with an end id, fill
whole windows as long as they can; what is left goes to a partially filled window. Of the fill
levels it fits on (a new window is level 0), it takes the one after which the sum over levels
of the squared number of windows at that level is least (Csirik et al. 2006); a level array
holds those numbers, ties go to the fullest level. When a task ends, the windows that are still
open are cut and joined into full ones, and the rest into windows whose lengths are powers of
two, which need no padding. A task keeps only its open windows in memory; beyond ``max_open``
of them it closes them the same way.

Every document is packed by the task that reads it: no shuffle, and a lost task is redone by
itself, with the same sequence numbers (task number, then window number).

Defined results
    * A null or empty text is its end id alone. A null ``doc_id`` stays null.
    * Repeated rows are packed each. Other columns are ignored. An empty table packs nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code
from litrank.llm.text_arrays import text_column
from litrank.llm.token_ids import json_encoder

PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquaresPacker:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` into windows of ``window`` ids."""

    def __init__(self, window: int, first_sequence: int, max_open: int = 1024):
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.level = np.zeros(window + 1, np.int64)      # open windows at each fill level
        self.open: dict[int, list[list]] = {}            # level -> windows, each a list of pieces
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list):
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray):
        w, n = self.window, len(ids)
        whole = n - n % w
        for s in range(0, whole, w):
            self._close([(doc, s, ids[s:s + w], n)])
        if n > whole:
            self._place((doc, whole, ids[whole:], n), n - whole)

    def _place(self, piece: tuple, size: int):
        w, count = self.window, self.level
        into = count[size:w + 1]                         # windows at the level after placing
        gain = 2 * into + 1
        gain[-1] = 0                                     # a full window is no open one
        here = count[:w - size + 1]
        cost = gain - 2 * here + 1
        cost[0] = gain[0]                                # a new window leaves no level
        cost[1:][here[1:] == 0] = np.iinfo(np.int64).max
        h = int(len(cost) - 1 - np.argmin(cost[::-1]))
        if h:
            pieces = self.open[h].pop()
            count[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == w:
            self._close(pieces)
            return
        self.open.setdefault(h + size, []).append(pieces)
        count[h + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.finish()

    def finish(self):
        """Cut and join the open windows, fullest first, into full ones; the rest into windows
        of power-of-two lengths."""
        rest = [p for h in sorted(self.open, reverse=True) for pieces in self.open[h] for p in pieces]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        left = sum(len(p[2]) for p in rest)
        room = lambda n: self.window if n >= self.window else 1 << (n.bit_length() - 1)
        free, window = room(left) if left else 0, []
        for doc, start, ids, total in rest:
            at = 0
            while at < len(ids):
                take = min(free, len(ids) - at)
                window.append((doc, start + at, ids[at:at + take], total))
                at, free, left = at + take, free - take, left - take
                if not free:
                    self._close(window)
                    free, window = room(left) if left else 0, []

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.done)) if self.done else [[]] * len(_SCHEMA)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _pack(batches, path: str, window: int, end_id: int):
    packer = SumOfSquaresPacker(window, TaskContext.get().partitionId() << 36)
    encoder, end = json_encoder(path), np.array([end_id], "<u4")
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for i, j, ids, offs in encoder.slices(text_column(batch)):
            ids = ids.astype("<u4", copy=False)
            for k in range(j - i):
                packer.add(docs[i + k], np.concatenate([ids[offs[k]:offs[k + 1]], end]))
            if packer.done:
                yield packer.batch()
    packer.finish()
    yield packer.batch()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of the documents in windows: one row for each piece, with its ids (unsigned
    32-bit, little-endian). ``tokenizer`` is a JSON file of the tokenizers library."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda x: _pack(x, tokenizer, window, end_id), PIECES)
