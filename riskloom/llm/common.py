"""What the operators share: tables by name, folds of ids, and a hash cache for words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.tokens import encoder

#: A word-to-hash cache is emptied when it holds more words than this.
CACHED_WORDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(encoders: bool = False) -> None:
    """Return freed memory to the system: a Python worker is reused, so a stage would hold what an earlier one let go.

    Token encoders that earlier stages left go too; tasks that encode keep ``encoders``.
    """
    if not encoders:
        encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bits of a bitmap of keys: 8 MB, in at most 2,048 rows.
KEY_BITS = 1 << 26
_BITMAP_BITS = 1 << 15


def flag_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where ``key`` is surely none of the wanted keys.

    A bitmap of the wanted keys' hashes, of bounded size, is broadcast; so rows that no exact join would match need not
    move.  Only built-in functions.  The more keys are wanted, the more rows are flagged without need.
    """

    def place(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(KEY_BITS))

    hashed = wanted.select(place(wanted_key).alias("at"))
    maps = hashed.groupBy(F.expr(f"at div {_BITMAP_BITS}").alias("__map")).agg(
        F.bitmap_construct_agg(F.col("at") % _BITMAP_BITS).alias("__bits")
    )
    found = rows.select("*", place(key).alias("__at")).join(F.broadcast(maps), F.expr(f"__at div {_BITMAP_BITS} = __map"), "left")
    byte = f"cast(conv(hex(substring(__bits, cast(__at % {_BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.coalesce(F.expr(f"(shiftright({byte}, cast(__at % 8 as int)) & 1) = 1"), F.lit(False))
    return found.withColumn(flag, bit).drop("__at", "__map", "__bits")


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def in_fold(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold_of(doc_id, folds) == which, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """``hashes[word]``: the 64-bit hash of a word, given as bytes or str; alike in every process."""

    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    out = words[:count].copy()
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, n):
        out = mix64(out * step + np.uint64(k)) ^ words[k : k + count]
    return mix64(out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Rows of sorted batches by key; a group of more than ``most`` rows comes in parts."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            cuts[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and (key != last or (most and sum(h.num_rows for h in held) + b - a > most)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
