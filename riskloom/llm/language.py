"""Language identification: script ranges narrow the candidates, then Viterbi labels spans of mixed-language text.

A word's score in a language is the sum of log probabilities of its hashed character n-grams.  Its script leaves only
languages that write it.  Over the words of a text, the best path of languages with a penalty for each switch gives
spans; the language with most letters in its spans is the text's.  All texts of a batch take their Viterbi steps
together.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import mix64
from riskloom.llm.sample import hash_sample

#: Bound of the labelled rows that the word scores are learned from.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0
#: A script counts as a language's if at least this share of its words is written in it.
SCRIPT_SHARE = 0.01
WRONG_SCRIPT = -60.0
CACHED = 300_000
UNKNOWN = "und"

# First code points of script ranges; letters below the first are Latin.
SCRIPT_RANGES = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPT_RANGES])
_NAMES = sorted({n for _, n in SCRIPT_RANGES})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPT_RANGES])


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of non-empty words, with the number of the word of each."""
    points = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    running = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size < 1:
            break
        running = mix64(running[:size] * np.uint64(31) + points[n - 1 :] + np.uint64(n))
        inside = owner[:size] == owner[n - 1 :]
        if n == 1:
            inside &= points != 32
        found.append((running[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:size][inside])
    return np.concatenate(found), np.concatenate(owners)


def _scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    return _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # language, bucket
    allowed: np.ndarray  # script, language


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Languages:
    """Learn from ``docs(text, lang)``, a bounded sample by hash of the text; null languages and texts teach nothing.

    Words are counted per language in Spark first; the driver gets one number for each language and bucket.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = hash_sample(known.select(F.xxhash64("text").alias("doc_id"), "lang", "text"), rows)
    words = known.select("lang", F.explode(F.split("text", "\\s+")).alias("word"))
    counts = words.filter(F.col("word") != "").groupBy("lang", "word").agg(F.count("*").alias("n"))

    def grams(batches):
        total: Counter = Counter()
        for batch in batches:
            batch["word"] = [letters_of(w) for w in batch["word"]]
            batch = batch[batch["word"] != ""]
            for lang, part in batch.groupby("lang"):
                texts, n = part["word"].tolist(), part["n"].to_numpy(np.float64)
                bucket, owner = _grams(texts)
                sums = np.bincount(bucket, n[owner], BUCKETS)
                for k in np.flatnonzero(sums):
                    total[lang, int(k)] += sums[k]
                for k, v in enumerate(np.bincount(_scripts(texts), n, len(_NAMES))):
                    total[lang, -1 - k] += v
        keys = list(total)
        yield pd.DataFrame(
            {"lang": [k[0] for k in keys], "bucket": [k[1] for k in keys], "n": [float(total[k]) for k in keys]}
        )

    per = counts.mapInPandas(grams, "lang string, bucket int, n double")
    found = per.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    table = np.zeros((len(names), BUCKETS))
    scripts = np.zeros((len(_NAMES), len(names)))
    row = found["lang"].map({n: k for k, n in enumerate(names)}).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
    gram = bucket >= 0
    table[row[gram], bucket[gram]] = n[gram]
    scripts[-1 - bucket[~gram], row[~gram]] = n[~gram]
    logs = np.log(table + 0.5) - np.log(table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script that no language is known for leaves all
    return Languages(names, logs, allowed)


class Labeller:
    """Labels texts; keeps the scores of the tokens it has seen."""

    def __init__(self, model: Languages):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.names)), dtype=np.float32)
        self.weights = np.zeros(0, dtype=np.int32)

    def _learn(self, new: list[str]) -> None:
        words = [letters_of(t) for t in new]
        at = [k for k, w in enumerate(words) if w]
        scores = np.zeros((len(new), len(self.model.names)), dtype=np.float32)
        if at:
            real = [words[k] for k in at]
            bucket, owner = _grams(real)
            for j in range(len(self.model.names)):
                scores[at, j] = np.bincount(owner, self.model.logs[j, bucket], len(real))
            scores[at] += np.where(self.model.allowed[_scripts(real)], 0.0, WRONG_SCRIPT)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, scores])
        self.weights = np.concatenate([self.weights, np.array([len(w) for w in words], dtype=np.int32)])

    def _numbers(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHED:
            self.__init__(self.model)
        out = []
        for a in range(0, len(texts), 500):
            tokens = [t.split() for t in texts[a : a + 500]]
            new: set[str] = set()
            for t in tokens:
                new.update(t)
            self._learn(list(new - self.number.keys()))
            out += [np.fromiter(map(self.number.__getitem__, t), dtype=np.int32, count=len(t)) for t in tokens]
        return out

    def label(self, texts: list[str], switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
        """Per text: language, share of its letters in spans of that language, and the spans (first word, end, language)."""
        if not self.model.names:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        numbers = self._numbers(texts)
        paths = self._paths(numbers, switch)
        out = []
        for words, path in zip(numbers, paths, strict=True):
            weight = self.weights[words]
            total = int(weight.sum())
            if not total:
                out.append((UNKNOWN, 0.0, []))
                continue
            mass = np.bincount(path, weight, len(self.model.names))
            best = int(np.argmax(mass))
            cut = np.flatnonzero(np.diff(path)) + 1
            ends = [*cut.tolist(), len(path)]
            names = [self.model.names[path[a]] for a in [0, *cut.tolist()]]
            spans = [{"start": a, "end": b, "lang": n} for a, b, n in zip([0, *ends], ends, names, strict=False)]
            out.append((self.model.names[best], float(mass[best] / total), spans))
        return out

    def _paths(self, numbers: list[np.ndarray], switch: float) -> list[np.ndarray]:
        """Best paths of all texts at once; texts in order of length, so that those still open stand first."""
        order = sorted(range(len(numbers)), key=lambda k: -len(numbers[k]))
        lengths = np.array([len(numbers[k]) for k in order], dtype=np.int64)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(numbers)
        if not len(lengths) or not lengths[0]:
            return out
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        words = np.concatenate([numbers[k] for k in order])
        width = len(self.model.names)
        kind = np.int8 if width < 127 else np.int16
        came = np.full(len(words), 0, dtype=kind)  # the best language before each word
        moved = np.zeros((len(words), width), dtype=bool)  # where a switch from it is better than staying
        open_at = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        best = np.zeros((len(lengths), width), dtype=np.float64)
        for t in range(int(lengths[0])):
            n = open_at[t]
            at = starts[:n] + t
            now = best[:n]
            if t:
                top = now.argmax(axis=1)
                jump = now[np.arange(n), top] - switch
                move = jump[:, None] > now
                came[at], moved[at] = top, move
                np.maximum(now, jump[:, None], out=now)
            now += self.scores[words[at]]
        path = np.zeros(len(words), dtype=kind)
        state = best.argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = open_at[t]
            at = starts[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = np.where(moved[at, state[:n]], came[at], state[:n])
        for k, a, n in zip(order, starts, lengths, strict=True):
            out[k] = path[a : a + n]
        return out


_LABELLER: tuple | None = None


def identify(text: Column, model: Languages) -> Column:
    """``struct(lang, score, spans)`` of a text column.

    A null text, one without letters, or any text when nothing was learned: ``und``, score 0, no spans.
    """

    @F.pandas_udf("lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        global _LABELLER
        if _LABELLER is None or _LABELLER[0] is not model:
            _LABELLER = model, Labeller(model)
        return pd.DataFrame(_LABELLER[1].label([t or "" for t in texts]), columns=["lang", "score", "spans"])

    return of(text)
