"""Token counts of whole texts by a two-tier lookup on the map side.

A tokenizer that drops white space splits a text there before anything else, so a text's count is the sum over its
words, and a word (here a pre-token: what lies between ASCII white space) has one count wherever it stands.  Tier one
is a compact table of frequent words and their counts, bounded by a parameter and broadcast.  Tier two is a cache in
each Python worker, bounded in bytes; words that neither holds are encoded, each once a batch.  Words are told apart
and looked up in Arrow's hash tables, and no word is ever shuffled.  A tokenizer that keeps white space, and any
sentence-piece model, takes the plain way: whole texts through its library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.sample import hash_sample

LIMIT = 2048
#: Rows whose words decide which counts are broadcast; this affects speed only.
SAMPLE_ROWS = 10_000
#: Words in the broadcast table, and the bytes of the longest: at most 65,536 * (64 + 2) bytes.
TABLE_WORDS = 1 << 16
TABLE_WORD_BYTES = 64
#: Bytes of a worker's cache, and what one entry takes besides its word.
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 160
#: Text bytes that one step looks at; a longer text is a step of its own.
STEP_BYTES = 4 << 20
WHITE = " \t\n\v\f\r"

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


def word_counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """``(counts of texts, whether a text may be cut at ASCII white space)`` for a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()

    def count(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tool.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return count, _drops_white_space(spec) and _adds_up(count)


def _drops_white_space(spec: dict) -> bool:
    """Whether the file's first split throws white space away and nothing before it looks across."""
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = norm.get("normalizers", [norm])
    local = all(
        s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ")
        for s in steps
    )
    split = spec.get("pre_tokenizer") or {}
    split = split.get("pretokenizers", [split])[0]
    dropped = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    added = any(t["normalized"] or set(t["content"]) & set(WHITE) for t in spec.get("added_tokens", []))
    return bool(local and dropped and not added and not spec["model"].get("dropout"))


def _adds_up(count: Callable[[list[str]], list[int]]) -> bool:
    """No kind of character holds on to another across any kind of white space."""
    kinds = ["a", "é", "7", "-", "'", "́", "漢"]
    pairs = [(x, y) for x in kinds for y in kinds]
    alone = dict(zip(kinds, count(kinds), strict=True))
    return all(
        got == alone[x] + alone[y]
        for w in WHITE
        for (x, y), got in zip(pairs, count([x + w + y for x, y in pairs]), strict=True)
    )


class CountCache:
    """Tier two and the way past it: ``of(words)`` for words that the broadcast table lacks."""

    def __init__(self, path: str):
        self.count, self.by_word = word_counter(path)
        self.known: dict[str, int] = {}
        self.held = 0

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in words if w not in known]
        fresh = dict(zip(new, self.count(new), strict=True)) if new else {}
        out = np.fromiter((known[w] if w in known else fresh[w] for w in words), dtype=np.int64, count=len(words))
        cost = sum(len(w) for w in new) * 2 + ENTRY_BYTES * len(new)
        if self.held + cost > CACHE_BYTES:
            self.known, self.held = {}, 0
        if cost <= CACHE_BYTES:
            self.known.update(fresh)
            self.held += cost
        return out


@cache
def counter(path: str) -> CountCache:
    """One cache for each vocabulary file and Python worker."""
    return CountCache(path)


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, told apart, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most ``STEP_BYTES``, or of one text."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")))
        yield texts.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def frequent_words(texts: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, most: int = TABLE_WORDS) -> pa.Table:
    """``(word, n)``: token counts of at most ``most`` words that are frequent in a bounded sample of ``texts``.

    Each task adds its words up before the shuffle; the sample bounds that shuffle, ``most`` what comes back.
    """
    schema = pa.schema([("word", pa.string()), ("seen", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch.column("text").cast(pa.large_string())):
                found = pc.value_counts(_words(part)[0])
                word = found.field("values")
                word = word.dictionary_decode() if pa.types.is_dictionary(word.type) else word
                short = pc.and_(
                    pc.less_equal(pc.binary_length(word), TABLE_WORD_BYTES), pc.greater(pc.binary_length(word), 0)
                )
                word, seen = word.filter(short), found.field("counts").filter(short)
                for k in range(0, len(word), 100_000):
                    yield pa.RecordBatch.from_arrays([word[k : k + 100_000].cast(pa.string()), seen[k : k + 100_000]], schema=schema)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            found = pa.array(count(batch.column("word").to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), found], names=["word", "n"])

    some = hash_sample(texts, sample_rows).select("text").mapInArrow(tally, "word string, seen long")
    top = some.groupBy("word").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "word").limit(most)
    return top.select("word").mapInArrow(lengths, "word string, n int").toArrow()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, table_words: int = TABLE_WORDS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of ``docs(doc_id, text)``, one row for each row.

    ``tokenizer`` is a ``.json`` file of the tokenizers library or a ``.model`` of sentencepiece.  Nothing is added at
    either end, and special strings inside a text count as the library takes them.  A null text is an empty one, with
    no bytes and no tokens; null and repeated ids are counted like others; a text of any length is counted whole; no
    rows give no rows.  Other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    frequent = None
    if word_counter(tokenizer)[1]:
        frequent = frequent_words(texts, tokenizer, most=table_words).combine_chunks()
    shared = spark.sparkContext.broadcast(
        None if frequent is None else (frequent["word"].to_pylist(), np.array(frequent["n"].to_pylist(), dtype=np.uint16))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        table = shared.value
        if table is not None:
            words, lengths = pa.array(table[0], pa.large_string()), np.append(table[1].astype(np.int64), 0)

        def of(part: pa.Array) -> np.ndarray:
            if table is None:
                return np.array(tool.count(part.to_pylist()), dtype=np.int64)
            found, starts = _words(part)
            own = found.dictionary
            place = pc.fill_null(pc.index_in(own, value_set=words), -1).to_numpy(zero_copy_only=False)
            n = lengths[place]
            missed = np.flatnonzero(place < 0)
            if len(missed):
                n[missed] = tool.of(own.take(pa.array(missed)).to_pylist())
            until = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum(n[found.indices.to_numpy(zero_copy_only=False)] if len(found) else n[:0], out=until[1:])
            return until[starts[1:]] - until[starts[:-1]]

        for batch in batches:
            whole = batch.column("text").cast(pa.large_string())
            tokens = [of(part) for part in _steps(whole)]
            n = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(whole).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                schema=_ARROW,
            )

    return texts.mapInArrow(count, COUNTS)
