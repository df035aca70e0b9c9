"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-cased letter and digit runs.  Every item has a seed for each of its n-grams.  A copy that reaches the
score holds most of the item's words, so at least one of a certain number of its rarest ones, whichever way these are
counted.  A first pass counts in how many documents the items' words stand.  A second one joins, in tasks, each
document with the items that share both a seed and one of their rare words with it; the items are the small side,
broadcast in blocks of bounded size.  Around each seed lies a window that holds every alignment through it which
reaches the score.  Windows without enough of the item's words cannot reach it; the others are merged where they
overlap and aligned, which finds edited and paraphrased copies too.  No text is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WordHashes, flag_among, give_back, ngram_hashes
from riskloom.session import materialize

SEED_WORDS = 3
#: Places on so many neighbouring diagonals start one window.
BAND = 8
#: Share of an item's best possible score from which a passage counts as a copy.
MIN_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that are broadcast at once, about, some 100 bytes each; more items take further passes.
BLOCK_WORDS = 500_000
#: Places of seeds in one document that are looked at together.
SPOTS = 1_000_000
#: Documents whose seeds are looked up together.
STEP_ROWS = 500

_WORD = re.compile(r"[^\W_]+")
_ASCII_GAPS = {k: " " for k in range(128) if not chr(k).isalnum()}


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return text.translate(_ASCII_GAPS).split() if text.isascii() else _WORD.findall(text)


class ItemWords:
    """Hashes of the items' words; every other word gets one hash that none of them has."""

    def __init__(self, words: Iterator[str]):
        hashes = WordHashes()
        self.known = {w: hashes[w] for w in words}
        taken = set(self.known.values())
        self.other = next(k for k in range(len(taken) + 1) if k not in taken)

    def of(self, words: list[list[str]]) -> np.ndarray:
        """The hashes of all words, one text after the other."""
        found = map(self.known.get, chain.from_iterable(words), repeat(self.other))
        return np.fromiter(found, dtype=np.uint64, count=sum(map(len, words)))


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and the stretch of ``doc`` (start, end) that it covers.

    One item word after the other against all document words at once; gaps along the document come from a running
    maximum, as the gap cost is linear.
    """
    n = len(doc)
    steps = GAP * np.arange(n + 1)
    row, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(doc == word, MATCH, MISMATCH)
        above = row[1:] + GAP
        value = np.maximum(0, np.maximum(diagonal, above))
        origin = np.where(value == 0, np.arange(1, n + 1), np.where(diagonal >= above, start[:-1], start[1:]))
        value, origin = np.concatenate([[0], value]), np.concatenate([[0], origin])
        reach = value - steps
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, np.arange(n + 1), 0))
        row, start = top + steps, origin[source]
        k = int(np.argmax(row))
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k)
    return best


class Lookup:
    """Sorted hashes that repeat, each with a value; ``find`` tells where some hashes stand in it."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], [v[order] for v in values]
        self.small = np.zeros(1 << 20, dtype=bool)
        self.small[self.hashes >> np.uint64(44)] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``wanted`` of those that are known, and the range of each in ``values``."""
        at = np.flatnonzero(self.small[wanted >> np.uint64(44)])
        first = np.searchsorted(self.hashes, wanted[at])
        end = np.searchsorted(self.hashes, wanted[at], side="right")
        known = end > first
        return at[known], first[known], end[known]


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = end - first
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class ItemBlock:
    """Items (ids, word hashes) with their seeds and their rare words.

    ``counts`` has the number of documents of each item word.  If so many of an item's words are missing as it has rare
    ones, the others cannot reach the score.
    """

    def __init__(self, ids: list, items: list[np.ndarray], counts: dict[int, int], min_score: float, n: int):
        self.ids, self.items, self.min_score, self.n = ids, items, min_score, n
        #: Items that words cannot rule out.
        self.open = np.zeros(len(items), dtype=bool)
        seeds, rare = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
        for k, item in enumerate(items):
            seeds.append(ngram_hashes(item, n))
            short = np.flatnonzero((len(item) - np.arange(len(item) + 1)) / max(1, len(item)) < min_score)
            self.open[k] = not len(short)
            ranks = np.array([counts.get(int(w), 0) for w in item], dtype=np.int64)
            rare.append(np.unique(item[np.lexsort((item, ranks))][: short[0] if len(short) else 0]))
        numbers = np.arange(len(items))
        self.seeds = Lookup(
            np.concatenate(seeds),
            np.repeat(numbers, [len(x) for x in seeds[1:]]),
            np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(len(x)) for x in seeds]]),
        )
        self.rare = Lookup(np.concatenate(rare), np.repeat(numbers, [len(x) for x in rare[1:]]))

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Items that share a seed and a rare word with ``words``, and the ranges of diagonals of the shared seeds."""
        spots, first, end = self.seeds.find(ngram_hashes(words, self.n))
        if not len(spots):
            return
        likely = self.open.copy()
        _, a, b = self.rare.find(np.unique(words))
        likely[self.rare.values[0][_ranges(a, b)]] = True
        found: list[tuple[np.ndarray, ...]] = []
        for part in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(np.cumsum(end - first) // SPOTS)) + 1):
            at = _ranges(first[part], end[part])
            item, diagonal = self.seeds.values[0][at], np.repeat(spots[part], (end - first)[part]) - self.seeds.values[1][at]
            kept = likely[item]
            found.append(_spans(item[kept], diagonal[kept] // BAND, diagonal[kept], diagonal[kept]))
        item, _, low, high = _spans(*(np.concatenate(c) for c in zip(*found, strict=True)))
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1)) if len(item) else [0]
        for x, y in zip(edges, edges[1:], strict=False):
            yield int(item[x]), list(zip(low[x:y].tolist(), high[x:y].tolist(), strict=True))


def _spans(item: np.ndarray, band: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One range of diagonals for each item and band, in their order."""
    order = np.lexsort((band, item))
    item, band, low, high = item[order], band[order], low[order], high[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    cuts = np.flatnonzero(new)
    if not len(cuts):
        return item, band, low, high
    return item[cuts], band[cuts], np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)


def _document_counts(docs: DataFrame, words: ItemWords) -> dict[int, int]:
    """In how many documents each of ``words`` (of bounded number) stands."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes = sent.value.known
        known, counts = frozenset(hashes), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(known.intersection(words_of(text)))
        found = np.array([hashes[w] for w in counts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([*counts.values()], pa.int64())], names=["word", "n"])

    seen = docs.select("text").mapInArrow(of, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(seen["word"].to_numpy(np.int64).view(np.uint64).tolist(), seen["n"].tolist(), strict=True))


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items with their words, dealt by hash to blocks of about ``BLOCK_WORDS``; one block is fetched at a time."""
    worded = materialize(_item_words(items).filter(F.size("item") > 0))
    total = worded.agg(F.sum(F.size("item"))).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    dealt = worded.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(max(1, count))))
    return [dealt.filter(F.col("block") == k).select("item_id", "item").orderBy("item_id", "item") for k in range(count)]


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, n: int = SEED_WORDS) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: the best copy of each item in each document, from ``min_score`` on.

    ``docs(doc_id long, text)``, ``items(item_id, text)``.  Score: alignment score over that of the item with itself.
    Items of fewer than ``n`` words have no seed and are never found.  Null texts are empty; null items are left out.
    Rows that repeat in id and text give one result.  No rows on a side give no rows.  Other columns are not looked at.
    """
    return _copies(docs, items, min_score, n).drop("doc")


def without_copies(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, n: int = SEED_WORDS) -> DataFrame:
    """The rows of ``docs``, null ids too, whose text holds no copy of an item; all columns."""
    gone = materialize(_copies(docs, items, min_score, n).select(F.col("doc").alias("__doc")).distinct())
    # Documents that surely have no copy stay where they are.
    flagged = flag_among(docs, _doc_key(), gone, F.col("__doc"), "__maybe")
    checked = flagged.filter("__maybe").join(gone, _doc_key() == gone["__doc"], "left_anti")
    return checked.unionAll(flagged.filter("NOT __maybe")).drop("__maybe")


def _doc_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _copies(docs: DataFrame, items: DataFrame, min_score: float, n: int) -> DataFrame:
    """As ``contaminated``, with the key ``doc`` of an id and its text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL").distinct()
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _doc_key().alias("doc"), "text"
    )
    parts = []
    for block in _blocks(items):
        rows = block.collect()
        words = ItemWords(chain.from_iterable(r["item"] for r in rows))
        counts = _document_counts(docs, words)
        block = ItemBlock([r["item_id"] for r in rows], [words.of([r["item"]]) for r in rows], counts, min_score, n)
        parts.append(_aligned(keyed, words, block))
    if not parts:
        parts = [keyed.limit(0).selectExpr("doc", "doc_id", "doc_id AS item_id", "0D AS score", "0L AS start_word", "0L AS end_word")]
    found = reduce(DataFrame.unionAll, parts)
    return (
        found.groupBy("doc", "doc_id", "item_id")
        .agg(F.max(F.struct("score", (-F.col("start_word")).alias("early"), "end_word")).alias("best"))
        .select(
            "doc",
            "doc_id",
            "item_id",
            F.col("best.score").alias("score"),
            (-F.col("best.early")).alias("start_word"),
            F.col("best.end_word").alias("end_word"),
        )
    )


def _item_words(items: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts])

    return items.select("item_id", of("text").alias("item"))


def windows(words: np.ndarray, item: np.ndarray, starts: list[tuple[int, int]], min_score: float) -> list[tuple[int, int]]:
    """Stretches ``(lo, hi)`` of ``words`` with every alignment through one of ``starts`` that reaches the score.

    ``starts`` are ranges of diagonals.  A score of ``min_score`` leaves points for at most ``room`` gaps, and needs so
    many of the item's words, each as often as it stands in the item.
    """
    room = max(0, int(np.ceil(MATCH * (1 - min_score) * len(item) / -GAP))) + 1
    known, times = np.unique(item, return_counts=True)
    out: list[tuple[int, int]] = []
    for low, high in sorted(starts):
        lo, hi = max(0, low - room), min(len(words), high + len(item) + room)
        place = np.searchsorted(known, words[lo:hi])
        place[place == len(known)] = 0
        seen = np.bincount(place[known[place] == words[lo:hi]], minlength=len(known))
        if np.minimum(seen, times).sum() / len(item) < min_score:
            continue
        if out and lo <= out[-1][1]:
            lo, hi = out[-1][0], max(hi, out.pop()[1])
        out.append((lo, hi))
    return out


def _seeded(block: ItemBlock, words: np.ndarray, starts: np.ndarray) -> list[int]:
    """Which of the texts that begin at ``starts`` of ``words`` hold a seed; the last start is the end."""
    spots, _, _ = block.seeds.find(ngram_hashes(words, block.n))
    text = np.searchsorted(starts, spots, side="right") - 1
    return np.unique(text[spots + block.n <= starts[text + 1]]).tolist()


def _aligned(texts: DataFrame, words: ItemWords, block: ItemBlock) -> DataFrame:
    """``doc, doc_id, item_id, score, start_word, end_word`` of passages of ``texts`` that reach the score."""
    sent = texts.sparkSession.sparkContext.broadcast((words, block))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, block = sent.value
        for part in (batch.slice(a, STEP_ROWS) for batch in batches for a in range(0, batch.num_rows, STEP_ROWS)):
            rows: list[tuple] = []
            split = [words_of(text) for text in part.column("text").to_pylist()]
            step, at = known.of(split), np.cumsum([0, *map(len, split)])
            for number in _seeded(block, step, at):
                key, doc_id = part.column("doc")[number], part.column("doc_id")[number]
                words = step[at[number] : at[number + 1]]
                for k, starts in block.candidates(words):
                    item = block.items[k].view(np.int64)
                    for lo, hi in windows(words.view(np.int64), item, starts, block.min_score):
                        points, start, end = align(words[lo:hi], block.items[k])
                        score = points / (MATCH * len(item))
                        if score >= block.min_score:
                            rows.append((key.as_py(), doc_id.as_py(), block.ids[k], score, lo + start, lo + end))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc", "doc_id", "item_id", "score", "start_word", "end_word"],
                )

    return texts.select("doc", "doc_id", "text").mapInArrow(
        of, "doc long, doc_id long, item_id long, score double, start_word long, end_word long"
    )
