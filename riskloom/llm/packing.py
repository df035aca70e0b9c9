"""Packing into training sequences: vector bin packing by the dot-product rule, in one pass without a shuffle.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has a limit of each.  Every task keeps a
pool of examples (its size is a parameter, so memory is bounded).  It opens a sequence and adds, again and again, the
example that fits and whose demand has the largest dot product with what the sequence has left, both as shares of the
limits.  When none fits, or one segment is left, the largest is cut to what is left.  Only the last sequence of a task
is short.  Examples longer than a sequence are cut into full sequences first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import give_back
from riskloom.llm.tokens import encoder

END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 64
POOL = 2048
#: Texts that are encoded together.
STEP_ROWS = 500

PIECES = """doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long,
    loss_tokens long, segment int, ids binary"""
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("loss_tokens", pa.int64()), ("segment", pa.int32()), ("ids", pa.binary())]
)


class Packer:
    """Packs one task's examples; ``out`` collects the pieces as tuples in the order of ``PIECES``."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int, first_sequence: int, with_ids: bool = True):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.pool = pool
        self.with_ids = with_ids
        self.next = first_sequence
        self.items: list[list] = []  # [key, ids, start, end, loss_from]
        self.out: list[tuple] = []

    def _loss(self, item, start: int, end: int) -> int:
        return max(0, end - max(start, item[4]))

    def _fit(self, item, tokens: int, loss: int) -> int:
        """How many ids of the item's start fit into so many tokens and loss-bearing tokens."""
        free = max(0, item[4] - item[2])  # ids before the loss begins
        return min(tokens, free + loss, item[3] - item[2])

    def _put(self, item, n: int, sequence: int, offset: int, segment: int) -> None:
        key, ids, start, _, _ = item
        part = ids[4 * start : 4 * (start + n)]
        loss = self._loss(item, start, start + n)
        total = len(ids) // 4
        self.out.append((key, start, n, zlib.crc32(part), total, sequence, offset, loss, segment, part if self.with_ids else None))
        item[2] = start + n

    def add(self, key, ids: bytes, loss_from: int) -> None:
        item = [key, ids, 0, len(ids) // 4, loss_from]
        while item[3] - item[2] >= self.max_tokens and self._fit(item, self.max_tokens, self.max_loss) == self.max_tokens:
            self._put(item, self.max_tokens, self.next, 0, 0)
            self.next += 1
        if item[2] < item[3]:
            self.items.append(item)
        if len(self.items) >= 2 * self.pool:
            self.pack(self.pool)

    def pack(self, leave: int) -> None:
        """Fill sequences until at most ``leave`` examples wait."""
        tokens = np.array([i[3] - i[2] for i in self.items], dtype=np.int64)
        loss = np.array([self._loss(i, i[2], i[3]) for i in self.items], dtype=np.int64)
        alive = np.ones(len(self.items), dtype=bool)
        waiting = len(self.items)
        while waiting > leave:
            left_tokens, left_segments, left_loss = self.max_tokens, self.max_segments, self.max_loss
            offset = segment = 0
            while left_tokens and left_segments and waiting:
                fits = alive & (tokens <= left_tokens) & (loss <= left_loss)
                if left_segments == 1 or not fits.any():
                    k = int(np.argmax(np.where(alive, tokens, -1)))
                    n = self._fit(self.items[k], left_tokens, left_loss)
                    if not n:  # no room for loss: an example whose next ids bear none
                        free = np.array([max(0, i[4] - i[2]) for i in self.items])
                        k = int(np.argmax(np.where(alive, free, -1)))
                        n = self._fit(self.items[k], left_tokens, left_loss)
                    if not n:
                        break
                else:
                    share = np.array([left_tokens, left_segments, left_loss]) / self.limits**2
                    k = int(np.argmax(np.where(fits, share[0] * tokens + share[1] + share[2] * loss, -1.0)))
                    n = int(tokens[k])
                lost = self._loss(self.items[k], self.items[k][2], self.items[k][2] + n)
                self._put(self.items[k], n, self.next, offset, segment)
                tokens[k] -= n
                loss[k] -= lost
                if not tokens[k]:
                    alive[k] = False
                    waiting -= 1
                offset, segment = offset + n, segment + 1
                left_tokens, left_segments, left_loss = left_tokens - n, left_segments - 1, left_loss - lost
            self.next += 1
        self.items = [i for i, a in zip(self.items, alive, strict=True) if a]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_TOKENS,
    loss_from: Column | None = None,
    pool: int = POOL,
    with_ids: bool = False,
    cache_bytes: int | None = None,
) -> DataFrame:
    """Pack ``docs(doc_id long, text string)``; one row for each piece (``PIECES``).

    ``loss_from`` is the number of leading tokens without loss (a prompt); none by default.  Sequence ids are unique;
    those of one task follow each other.  A null or empty text is the end id alone; null and repeated ids are packed
    like others; no rows give no rows.  Other columns are not looked at.  Bytes of ids only ``with_ids``.  ``cache_bytes``
    bounds what a worker keeps of units encoded before.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("every limit must be positive")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(loss_from if loss_from is not None else F.lit(0), F.lit(0)).cast("long").alias("loss_from"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(encoders=True)
        packer = Packer(max_tokens, max_segments, max_loss, pool, TaskContext.get().partitionId() << 32, with_ids)
        tool, end = encoder(tokenizer, cache_bytes), np.array([end_id], dtype="<u4").tobytes()

        def batch_of() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            columns = [*zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
            )

        for batch in batches:
            for a in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(a, STEP_ROWS)
                found = tool.encode(part.column("text").to_pylist())
                starts = part.column("loss_from").to_pylist()
                for key, ids, start in zip(part.column("doc_id").to_pylist(), found, starts, strict=True):
                    packer.add(key, ids + end, start)
                if packer.out:
                    yield batch_of()
        packer.pack(0)
        if packer.out:
            yield batch_of()

    packed = rows.mapInArrow(pack, PIECES)
    return packed if with_ids else packed.drop("ids")
