"""Token-ID output: fixed-size blocks of ids as byte or bit planes, compressed plane by plane, with a chunk index.

The file format is a folder of two Parquet tables.  ``blocks`` has a row for each block of a shard: its number, the
place of its first id in the shard, one zstandard frame for each plane, and the documents it touches.  ``index`` is
the chunk index: a row for each block with its place among all ids, its first document and its size, so that a
reader finds the block of an id without opening ``blocks``.  A shard is one range of document ids; ids ascend
through shards, and through blocks in a shard.  Parquet gives atomic commits when executors are lost, and a read of
the index does not touch the planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.tokens import encoder

BLOCK_IDS = 65_536
END_ID = 2

_BLOCKS = """shard int, block int, local_start long, n_ids int, plane_kind string, planes array<binary>,
    doc_no array<long>, doc_id array<long>, doc_start array<long>, doc_tokens array<long>"""
_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("local_start", pa.int64()),
        ("n_ids", pa.int32()),
        ("plane_kind", pa.string()),
        ("planes", pa.list_(pa.binary())),
        ("doc_no", pa.list_(pa.int64())),
        ("doc_id", pa.list_(pa.int64())),
        ("doc_start", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
    ]
)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose ids into 4 byte planes or 32 bit planes, lowest first."""
    if kind == "byte":
        return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel()
    out = np.zeros(n, dtype=np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def _blocks_of(tokenizer: str, end_id: int, block_ids: int, kind: str, level: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, squeeze, tail = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=level), b""
        end = np.array([end_id], dtype="<u4").tobytes()
        docs: list[tuple] = []  # (number, id, start, tokens) of those that reach into the open block
        block = written = number = total = 0

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal block, written, docs
            ids = np.frombuffer(data, dtype="<u4")
            until = written + len(ids)
            here = [d for d in docs if d[2] < until]
            planes = [squeeze.compress(p) for p in to_planes(ids, kind)]
            values = [shard, block, written, len(ids), kind, planes, *([d[k] for d in here] for k in range(4))]
            block, written = block + 1, until
            docs = [d for d in docs if d[2] + d[3] > until]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW
            )

        size, tool = 4 * block_ids, encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                open_parts = [tail]
                held = len(tail)
                for key, ids in zip(keys, tool.encode(texts), strict=True):
                    n = len(ids) // 4 + 1
                    docs.append((number, key, total, n))
                    number, total = number + 1, total + n
                    open_parts += [ids, end]
                    held += 4 * n
                    if held >= size:
                        data = b"".join(open_parts)
                        full = len(data) - len(data) % size
                        for a in range(0, full, size):
                            yield row(data[a : a + size])
                        open_parts = [data[full:]]
                        held = len(data) - full
                tail = b"".join(open_parts)
        if tail:
            yield row(tail)

    return encode


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    kind: str = "byte",
    level: int = 3,
) -> None:
    """Encode ``docs(doc_id long, text string)`` and write the folder.

    Rows go in ascending ``doc_id``, null ids first, equal ids by a hash of their text.  A null or empty text has
    the end id alone.  No rows: two empty tables.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(_blocks_of(tokenizer, end_id, block_ids, kind, level), _BLOCKS).write.option(
        "compression", "none"
    ).parquet(f"{folder}/blocks")
    blocks = read_blocks(spark, folder)
    size = F.aggregate(F.transform("planes", F.length), F.lit(0), lambda a, b: a + b)
    index = blocks.join(_shard_starts(blocks), "shard").select(
        "shard",
        "block",
        (F.col("shard_start") + F.col("local_start")).alias("start"),
        "n_ids",
        F.get("doc_id", F.lit(0)).alias("first_doc_id"),
        size.cast("long").alias("plane_bytes"),
    )
    index.write.parquet(f"{folder}/index")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """How many ids lie in earlier shards; one row for each shard goes through the window."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _decode(planes: list, n: int, kind: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    return from_planes([expand.decompress(p) for p in planes], n, kind)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with their ids as an array."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = _decode(r["planes"], r["n_ids"], r["plane_kind"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([ids.tolist()])],
                    names=["shard", "block", "ids"],
                )

    blocks = read_blocks(spark, folder).select("shard", "block", "n_ids", "plane_kind", "planes")
    return blocks.mapInArrow(decode, "shard int, block int, ids array<long>")


# ------------------------------------------------------------ checksums


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
        bit >>= 1
    return out


def shifted_crc(crc: int, n_bytes: int) -> int:
    """What ``crc`` adds to the CRC-32 of a text in which ``n_bytes`` bytes follow; parts combine by exclusive or."""
    power, n = 1 << 23, n_bytes  # x^8: one byte
    while n:
        if n & 1:
            crc = _times(power, crc)
        power, n = _times(power, power), n >> 1
    return crc


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the planes: doc_id, start, n_tokens, ids_crc32.

    Each block is decoded alone.  A document that spans blocks gets one part from each; its checksum is the
    exclusive or of the parts, each moved past the ids that follow it, so no task gathers a document.
    """
    out = pa.schema(
        [(n, pa.int64()) for n in ("doc_no", "doc_id", "doc_start", "n", "crc")] + [("shard", pa.int32())]
    )

    def parts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = _decode(r["planes"], r["n_ids"], r["plane_kind"]).astype("<u4")
                rows = []
                lo, hi = r["local_start"], r["local_start"] + r["n_ids"]
                for no, key, start, n in zip(r["doc_no"], r["doc_id"], r["doc_start"], r["doc_tokens"], strict=True):
                    a, b = max(lo, start), min(hi, start + n)
                    crc = zlib.crc32(ids[a - lo : b - lo].tobytes())
                    rows.append((no, key, start, b - a, shifted_crc(crc, 4 * (start + n - b)), r["shard"]))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )

    blocks = read_blocks(spark, folder)
    pieces = blocks.mapInArrow(
        parts, "doc_no long, doc_id long, doc_start long, n long, crc long, shard int"
    )
    docs = pieces.groupBy("shard", "doc_no", "doc_id", "doc_start").agg(
        F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    return docs.join(_shard_starts(blocks), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32"
    )
