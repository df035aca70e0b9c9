"""Alignment of two tokenizers' tokens over the bytes of whole texts, and how often ids are linked corpus-wide.

Tokens of both sides are nodes.  Every token points to its farthest-right overlapping token of the other side; where
both end together, the token of side A is the end of the road.  Doubling all successors at once (pointer jumping)
leads each token to the last token of its connected component, which so names the component: those are the groups
between byte offsets at which both sides end.  All documents of a step are worked on in one array.

Links are counted in how many documents hold them.  Each document stores its distinct links once; tasks add up their
documents' links before the shuffle.  Counts of frequent links come back in a broadcast table of bounded size, and the
rest, of which no single one is frequent, are joined by link.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tokens import TokenEncoder
from riskloom.session import materialize, run_dir

#: Text bytes of one step; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Links of one task that are added up before they are sent on.
HELD_LINKS = 2_000_000
#: Links whose counts are broadcast, at most: 16 bytes each.
FREQUENT_LINKS = 1 << 18

COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_STORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in COLUMNS]
    + [("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary())]
)
_STORED_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"
_SCORED_DDL = """row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    n_best long, count_sum long, rest array<struct<link: long, times: long>>"""


def _byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = TokenEncoder(path_a, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = _byte_of()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # Every id as text with what may follow it; see ``group_text``.
        self.shown = np.array(
            [f"{k}{s}" for s in ",|" for k in range(len(self.bytes_a))] + [f"{k}{s}" for s in ",;" for k in range(len(self.bytes_b))],
            dtype=object,
        )

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for a text that is empty or that either side doesn't give back byte for byte."""
        wanted = [(" " + t).encode() for t in texts]
        found_a = [np.frombuffer(x, dtype="<u4") for x in self.a.encode([" " + t for t in texts])]
        found_b = self.b.encode(texts, num_threads=1)
        none = np.zeros(0, dtype=np.int64)
        out_a, out_b = [], []
        for text, whole, a, b in zip(texts, wanted, found_a, found_b, strict=True):
            same = bool(text) and (len(a) == 0 or int(a.max()) < len(self.bytes_a))
            same = same and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
            same = same and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out_a.append(a.astype(np.int64) if same else none)
            out_b.append(np.array(b, dtype=np.int64) if same else none)
        return out_a, out_b


@cache
def sides(path_a: str, path_b: str) -> Sides:
    """Both tokenizers, once for each pair of files and Python worker."""
    return Sides(path_a, path_b)


def farthest_right(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Each token's farthest-right overlapping token of the other side; A tokens come first, ends grow on each side."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the B token that holds the last byte of each A token
    over_b = np.searchsorted(ends_a, ends_b)
    to = np.concatenate([n + over_a, over_b])
    shared = np.flatnonzero(ends_b[over_a] == ends_a) if n else over_a
    to[shared] = shared  # both end here: the A token is the last of its component
    return to


def terminals(successor: np.ndarray) -> np.ndarray:
    """Where each node's road ends: successors are doubled until none changes."""
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(terminal tokens, group of each A token, group of each B token)``, groups from left to right."""
    last = terminals(farthest_right(ends_a, ends_b))
    named = np.zeros(len(last), dtype=bool)
    named[last] = True
    group = (np.cumsum(named) - 1)[last]
    return np.flatnonzero(named), group[: len(ends_a)], group[len(ends_a) :]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping A and B tokens: one for each stretch between neighbouring ends of either side."""
    stops = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs are merged
    stops = stops[np.diff(stops, prepend=-1) > 0]
    return np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)


def group_text(tool: Sides, ids_a, ids_b, group_a, group_b) -> tuple[np.ndarray, np.ndarray]:
    """``(pieces, group of each piece)``: ids with separators in the order ``a1,a2|b1;...``; each group ends with ``;``."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    many_a, many_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_b = np.cumsum(many_b) - many_b
    until_a = np.cumsum(many_a)
    last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    last_a[until_a - 1] = 1
    last_b[before_b + many_b - 1] = 1
    code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    group = np.empty_like(code)
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + until_a[group_b]
    size_a, size_b = len(tool.bytes_a), len(tool.bytes_b)
    code[at_a], group[at_a] = ids_a + size_a * last_a, group_a
    code[at_b], group[at_b] = 2 * size_a + ids_b + size_b * last_b, group_b
    return tool.shown[code], group


def _align(tool: Sides, texts: list[str]) -> Iterator[tuple]:
    """For each text ``(n_a, n_b, n_groups, n_links, groups_sha256, distinct links, times of each)``."""
    found_a, found_b = tool.encode(texts)
    count_a, count_b = np.array([len(x) for x in found_a]), np.array([len(x) for x in found_b])
    ids_a, ids_b = np.concatenate(found_a), np.concatenate(found_b)
    # Documents follow each other in one row of bytes, so that no token reaches into another document.
    ends_a, ends_b = np.cumsum(tool.length_a[ids_a]), np.cumsum(tool.length_b[ids_b])
    doc_a = np.repeat(np.arange(len(texts)), count_a)
    names, group_a, group_b = components(ends_a, ends_b)
    n_groups = np.bincount(doc_a[names], minlength=len(texts))
    pieces, piece_group = group_text(tool, ids_a, ids_b, group_a, group_b)
    cuts = np.searchsorted(piece_group, np.cumsum(n_groups))
    link_a, link_b = overlaps(ends_a, ends_b)
    n_links = np.bincount(doc_a[link_a], minlength=len(texts))
    links = ids_a[link_a] * len(tool.bytes_b) + ids_b[link_b]
    until = np.cumsum(n_links)
    start = piece = 0
    for k in range(len(texts)):
        text = "".join(pieces[piece : cuts[k]])[:-1]
        distinct, times = np.unique(links[start : until[k]], return_counts=True)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_groups[k] else ""
        yield int(count_a[k]), int(count_b[k]), int(n_groups[k]), int(n_links[k]), digest, distinct, times
        start, piece = until[k], cuts[k]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, text in enumerate(texts):
        if k > start and held + len(text) > STEP_BYTES:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def link_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The stored form of ``docs``: one row each, its digests, and its distinct links with their times."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sides(path_a, path_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                rows = [*zip(*_align(tool, texts[a:b]), strict=True)]
                rows[5] = [x.astype("<i8").tobytes() for x in rows[5]]
                rows[6] = [x.astype("<i4").tobytes() for x in rows[6]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id")]
                    + [pa.array(c, f.type) for c, f in zip(rows, [*_STORED][2:], strict=True)],
                    schema=_STORED,
                )

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    folder = run_dir(docs.sparkSession, "links")
    texts.mapInArrow(align, _STORED_DDL).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(_STORED_DDL).parquet(folder)


def count_links(stored: DataFrame) -> DataFrame:
    """``(link, n)``: how many documents hold each link."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def added() -> Iterator[pa.RecordBatch]:
            links, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, "<i8"),) * 2
            for k in range(0, len(links), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(links[k : k + 200_000]), pa.array(n[k : k + 200_000])], names=["link", "n"])

        for batch in batches:
            for data in batch.column("links").to_pylist():
                held.append(np.frombuffer(data, dtype="<i8"))
                size += len(held[-1])
                if size >= HELD_LINKS:
                    yield from added()
                    held, size = [], 0
        yield from added()

    return stored.select("links").mapInArrow(tally, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(links, counts, whether best, least count)``: all links from that power of two on, at most ``most``."""
    steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("many")).collect()
    total, least = 0, 1 << 62
    for step, many in sorted(((r["step"], r["many"]) for r in steps), reverse=True):
        total += many
        if total > most:
            break
        least = 1 << step
    kept = counted.filter(F.col("n") >= least).toArrow().sort_by("link")
    columns = (kept[c].to_numpy() for c in ("link", "n", "best"))
    return (*columns, least)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_LINKS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: token, group and link counts, and a digest of the groups.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, ``path_b`` a sentencepiece model; both sides cover
    the bytes of a space and the text, special strings inside a text are plain text.  ``count_sum`` adds up, over the
    document's links, in how many documents of the corpus the link's pair of ids is linked; ``n_best`` counts the links
    whose number is the highest of their A id, ties included.  A null or empty text, and one that either side doesn't
    give back byte for byte, has no tokens: zeros and an empty digest.  Null and repeated ids are rows like others, and
    each row counts as a document; a text of any length is aligned whole; no rows give no rows.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    stored = link_documents(docs, path_a, path_b)
    n_b = len(sides(path_a, path_b).bytes_b)
    counted = materialize(count_links(stored))
    # One row for each A id that occurs: bounded by the vocabulary.
    highest = counted.groupBy(F.expr(f"link div {n_b}").alias("a")).agg(F.max("n").alias("top"))
    marked = counted.join(F.broadcast(highest), F.expr(f"link div {n_b} = a")).select("link", "n", (F.col("n") == F.col("top")).alias("best"))
    counted = materialize(marked)
    *table, least = _frequent(counted, frequent)
    shared = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        pairs = pa.list_(pa.struct([("link", pa.int64()), ("times", pa.int64())]))
        for batch in batches:
            links = [np.frombuffer(x, dtype="<i8") for x in batch.column("links").to_pylist()]
            doc = np.repeat(np.arange(len(links)), [len(x) for x in links])
            link = np.concatenate([*links, np.zeros(0, "<i8")])
            times = np.concatenate([*(np.frombuffer(x, dtype="<i4") for x in batch.column("times").to_pylist()), np.zeros(0, "<i4")]).astype(np.int64)
            place = np.searchsorted(known, link)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == link[hit]
            where, to = np.flatnonzero(hit), place[hit]
            sums, bests = np.zeros(len(links), dtype=np.int64), np.zeros(len(links), dtype=np.int64)
            np.add.at(sums, doc[where], n[to] * times[where])
            np.add.at(bests, doc[where], best[to] * times[where])
            miss = np.flatnonzero(~hit)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[miss], minlength=len(links)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(link[miss]), pa.array(times[miss])], ["link", "times"])
            ).cast(pairs)
            names = ["row", "doc_id", *COLUMNS, "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(bests), pa.array(sums), rest], names=[*names, "n_best", "count_sum", "rest"]
            )

    scored = materialize(stored.mapInArrow(score, _SCORED_DDL))
    rare = scored.select("row", F.inline("rest")).join(counted.filter(F.col("n") < least), "link")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    whole = scored.drop("rest").join(rare, "row", "left")
    return whole.select(
        "doc_id",
        *COLUMNS,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
