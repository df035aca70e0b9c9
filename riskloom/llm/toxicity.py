"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

A lexicon of words that mark toxic texts is learned from the sample by log odds.  Features are its densities, how
near its words stand to second-person words, capitals, punctuation and obfuscation rates.  Trees are fitted on one
part of the sample and calibrated on another; with few rows of a class, lexicon and calibration are cross-fitted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.sample import class_sample, sample_texts
from riskloom.session import materialize

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
LEXICON_WORDS = 400
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5)
#: Log odds from which a lexicon word counts as strong.
STRONG_ODDS = 3.5
NEAR = 6
TREES = 30
DEPTH = 3
#: With fewer different texts of a class, all rows serve lexicon, trees and calibration, by cross-fitting.
FEW = 300
FOLDS = 4
FEW_TREES = 10
FEW_DEPTH = 2
CACHED = 300_000
FEATURES = (
    "strong_density", "weak_density", "strong_hits", "weak_hits", "weight_sum", "weight_max", "second_person",
    "near_hits", "nearness", "capitals", "hit_capitals", "exclamations", "punctuation", "obfuscated",
    "obfuscated_hits", "log_words",
)

# Second-person words, English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself you're du dich dir dein deine ihr euch euer tu te toi ton tes vous votre vos tú ti usted "
    "ustedes vosotros tus".split()
)
# Signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
_INNER = re.compile(r"[\W\d_]")
_STRONG, _SECOND, _UPPER, _ODD = 1 << 20, 1 << 21, 1 << 22, 1 << 23


class Words(dict):
    """What a token is, as bits: the number of its lexicon word, and signs."""

    def __init__(self, lexicon: dict[str, float], strong: float):
        super().__init__()
        self.number = {w: k + 1 for k, w in enumerate(lexicon)}
        self.weights = np.array([0.0, *lexicon.values()])
        self.strong = strong

    def find(self, word: str) -> int:
        """The number of the entry with the largest weight that fits; 0 if none does."""
        fits = [self.number.get(word, 0), *(self.number.get(f"{word[:n]}*", 0) for n in STEMS if len(word) > n)]
        return max(fits, key=self.weights.__getitem__)

    def __missing__(self, token: str) -> int:
        bare = token.strip(_EDGES)
        word = bare.lower()
        k, bits = self.find(word), 0
        if _INNER.search(bare) and any(c.isalpha() for c in bare) or (token[:1] in "@$" and bare):
            plain = _INNER.sub("", token.strip(".,;:?\"'()").lower().translate(LOOKALIKE))
            bits |= _ODD
            k = k or self.find(plain)
        if word in SECOND_PERSON:
            bits |= _SECOND
        if len(bare) > 1 and bare.isupper():
            bits |= _UPPER
        if k and self.weights[k] >= self.strong:
            bits |= _STRONG
        value = self[token] = k | bits
        return value


def features(text: str, words: Words) -> list[float]:
    """Features of a whole text; an empty text has zeros."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n = len(tokens)
    bits = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=n)
    number = bits & (_STRONG - 1)
    hits = np.flatnonzero(number)
    second = np.flatnonzero(bits & _SECOND)
    strong = int(((bits[hits] & _STRONG) > 0).sum())
    weights = words.weights[number[hits]]
    near = nearness = 0.0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        before = np.abs(hits - second[np.maximum(at - 1, 0)])
        after = np.abs(second[np.minimum(at, len(second) - 1)] - hits)
        gap = np.minimum(before, after)
        near, nearness = float((gap <= NEAR).sum()), 1 / (1 + float(gap.min()))
    upper = (bits & _UPPER) > 0
    odd = (bits & _ODD) > 0
    marks = text.count("!") + text.count("?")
    return [
        strong / n,
        (len(hits) - strong) / n,
        float(strong),
        float(len(hits) - strong),
        float(weights.sum()),
        float(weights.max()) if len(hits) else 0.0,
        len(second) / n,
        near,
        nearness,
        float(upper.mean()),
        float(upper[hits].mean()) if len(hits) else 0.0,
        marks / n,
        sum(map(text.count, ".,;:*#%&$")) / n,
        float(odd.mean()),
        float(odd[hits].sum()),
        float(np.log(n)),
    ]


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    strong: float
    trees: object | None
    calibration: object | None
    constant: float


def _features(lexicon: dict[str, float], strong: float):
    """A vectorised function of a text column."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        global _WORDS
        if _WORDS is None or _WORDS[0] != (lexicon, strong) or len(_WORDS[1]) > CACHED:
            _WORDS = (lexicon, strong), Words(lexicon, strong)
        words = _WORDS[1]
        return pd.Series([np.array(features(t or "", words)) for t in texts])

    return of


_WORDS = None


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words, and stems such as ``abcd*``, that mark toxic texts, with their log odds; at most ``LEXICON_WORDS``.

    They are ranked by the likelihood ratio of toxic against other texts that hold them.  A text that repeats in the
    sample counts once.
    """
    texts = sample.groupBy(F.xxhash64("text").alias("same"), "label").agg(F.first("text").alias("text"))
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}']+"), lambda w: F.length(w) > 1)
    stems = [
        F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*")))
        for n in STEMS
    ]
    held = texts.select("label", F.explode(F.array_distinct(F.concat(words, *stems))).alias("word"))
    total = texts.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    bad, every = float(total["bad"] or 0), float(total["all"])
    if not 0 < bad < every:
        return {}
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = a + b
    odds = F.log((a + 1) / (bad + 2)) - F.log((b + 1) / (every - bad + 2))
    ratio = a * F.log(a * every / (n * bad)) + F.coalesce(b * F.log(b * every / (n * (every - bad))), F.lit(0.0))
    best = (
        held.groupBy("word")
        .agg(F.sum("label").alias("a"), (F.count("*") - F.sum("label")).alias("b"))
        .filter(F.col("a") >= (4 if bad >= 40 else 2))
        .select("word", odds.alias("odds"), ratio.alias("ratio"))
        .filter((F.col("odds") > 1) & (F.col("ratio") > 5))
        .orderBy(F.desc("ratio"), "word")
        .limit(LEXICON_WORDS)
    )
    return {r["word"]: float(r["odds"]) for r in best.collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learn from a bounded sample of rows labelled 0 or 1.  No row of a class: a constant score."""
    texts = sample_texts(docs, class_sample(labels, label, rows)).withColumn("same", F.xxhash64("text"))
    sample = materialize(texts)
    counted = sample.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("same").alias("texts")).collect()
    classes = {r["label"]: r["n"] for r in counted}
    if len(classes) < 2:
        constant = (classes.get(1, 0) + 0.5) / (sum(classes.values()) + 1) if classes else 0.0
        return Toxicity({}, STRONG_ODDS, None, None, float(constant))
    fewest = min(r["texts"] for r in counted)
    if fewest < FEW:
        lexicon, trees, held = _cross_fitted(sample, max(2, min(FOLDS, fewest)))
    else:
        # Trees and calibration see other texts than the lexicon, whose words would else look too good.
        part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10))
        lexicon = learn_lexicon(sample.filter(part < 4))
        rest = _seen(sample.filter(part >= 4).withColumn("fit", part < 8), lexicon, "fit")
        rest = materialize(rest).withColumn("features", array_to_vector("x"))
        trees = _trees(TREES, DEPTH).fit(rest.filter("fit"))
        held = _margins(trees, rest.filter("NOT fit"))
    # The calibration alone has to know how rare a class is before sampling.
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score", weightCol="weight")
    return Toxicity(lexicon, STRONG_ODDS, trees, isotonic.fit(held), 0.0)


def _seen(sample: DataFrame, lexicon: dict[str, float], *columns: str) -> DataFrame:
    of = _features(lexicon, STRONG_ODDS)
    return sample.select(F.col("label").cast("double").alias("label"), "weight", of("text").alias("x"), *columns)


def _trees(trees: int, depth: int) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=11)


def _margins(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).select("label", "weight", vector_to_array("rawPrediction")[1].alias("margin"))


def _cross_fitted(sample: DataFrame, folds: int) -> tuple[dict[str, float], object, DataFrame]:
    """Lexicon and trees of all rows, and margins of all rows by trees and lexicons that have not seen them.

    Each fold has its share of each class; equal texts are in one fold.
    """
    kinds = sample.groupBy("same").agg(F.max("label").alias("kind"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("same"))
    dealt = materialize(kinds.select("same", (place % folds).alias("fold")))
    sample = materialize(sample.join(dealt, "same"))
    rest = None
    for k in range(folds):
        part = _seen(sample.filter(F.col("fold") == k), learn_lexicon(sample.filter(F.col("fold") != k)), "fold")
        rest = part if rest is None else rest.union(part)
    rest = materialize(rest.coalesce(8)).withColumn("features", array_to_vector("x"))
    fit = _trees(FEW_TREES, FEW_DEPTH)
    held = None
    for k in range(folds):
        margins = _margins(fit.fit(rest.filter(F.col("fold") != k)), rest.filter(F.col("fold") == k))
        held = margins if held is None else held.union(margins)
    return learn_lexicon(sample), fit.fit(rest), held


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs(doc_id, text)`` as ``doc_id, score``; a null text is scored as an empty one."""
    if model.trees is None:
        return docs.select("doc_id", F.lit(model.constant).alias("score"))
    of = _features(model.lexicon, model.strong)
    seen = docs.select("doc_id", array_to_vector(of(F.col("text"))).alias("features"))
    margin = vector_to_array("rawPrediction")[1]
    raw = model.trees.transform(seen).select("doc_id", margin.alias("margin"))
    score: Column = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return model.calibration.transform(raw).select("doc_id", score.alias("score"))
