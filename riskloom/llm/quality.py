"""Quality classifier: a generalised additive model with pairs over features of the whole text.

``fit_quality`` learns from a bounded sample of labelled rows; each of a few tasks boosts one model over the sample
under its own random weights, and their lookup tables are averaged.  ``quality_score`` scores any text column by bin
additions over whole batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import mix64
from riskloom.llm.gam import Model, fit
from riskloom.llm.sample import labelled_sample, sample_texts

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
BAGS = 3
FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "punctuation", "not_ascii", "distinct_words", "top_word",
    "word_concentration", "adjacent_repeats", "repeated_trigrams", "log_line_words", "repeated_lines",
    "symbol_ends", "stop_ends", "compression", "long_words", "byte_entropy",
)

_UPPER = slice(65, 91)
_LOWER = slice(97, 123)
_DIGIT = slice(48, 58)
_PLAIN_END = np.zeros(256, dtype=bool)
_PLAIN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[*b".,;:?)\"'"]] = True


def features(text: str) -> list[float]:
    """Features of a whole text; an empty text has zeros."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum()
    not_ascii = counts[128:].sum()
    digits = counts[_DIGIT].sum()
    visible = counts[33:127].sum()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=n)
    times = np.unique(ids, return_counts=True)[1] / n
    if n > 2:
        runs = mix64(mix64(ids[:-2].view(np.uint64)) ^ ids[1:-1].view(np.uint64)) ^ ids[2:].view(np.uint64)
        repeated = 1 - len(np.unique(runs)) / len(runs)
    else:
        repeated = 0.0
    lines = [x for x in data.split(b"\n") if x]
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)
    share = counts[counts > 0] / size
    return [
        float(np.log(n)),
        float(lengths.mean()),
        counts[_UPPER].sum() / max(1, letters),
        digits / size,
        (visible - letters - digits) / size,
        not_ascii / size,
        len(times) / n**0.8,
        float(times.max()),
        float((times**2).sum()),
        float((ids[1:] == ids[:-1]).sum() / n),
        repeated,
        float(np.log(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        float((~_PLAIN_END[ends] & ~_STOPS[ends]).mean()),
        float(_STOPS[ends].mean()),
        len(zlib.compress(data, 1)) / size,
        float((lengths > 20).mean()),
        float(-(share * np.log(share)).sum()),
    ]


def matrix(texts: pd.Series) -> np.ndarray:
    """Null texts count as empty."""
    return np.array([features(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of ``label`` (0 or 1); None if there is no labelled row.

    Rows with a null id or another label are not used; an id that repeats counts each time.  The driver gets the
    lookup tables only.
    """

    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(text)))

    def boost(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "label"], kind="stable")
        bag = mix64(np.array([key[0]], dtype=np.uint64))
        weight = np.ones(len(part))
        if key[0]:  # the first model sees the sample as it is
            weight = 0.5 + mix64(part["doc_id"].to_numpy(np.int64).view(np.uint64) ^ bag) / 2.0**64
        x = np.array(part["x"].tolist())
        return pd.DataFrame({"model": [fit(x, part["label"].to_numpy(np.float64), weight)]})

    sample = sample_texts(docs, labelled_sample(labels, label, rows))
    seen = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", of("text").alias("x"))
    bags = seen.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1))))
    found = bags.groupBy("bag").applyInPandas(boost, "model string").collect()
    return Model(sorted(r.model for r in found)) if found else None


def quality_score(text: Column, model: Model | None) -> Column:
    """Score of a text column, 0 to 1; 0.5 without a model.  Null and empty texts are scored like a text without words."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return score(text) if model else F.lit(0.5)
