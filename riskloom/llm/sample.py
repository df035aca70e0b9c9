"""A bounded sample of labelled rows for fitting classifiers, spread evenly by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows ``(doc_id, label int)`` of those whose label is 0 or 1, or all if they are fewer.

    The share is set from a count, then each id is kept or not by its hash, so no task and no driver gathers rows.
    """
    return hash_sample(_labelled(labels, label), rows)


def _labelled(labels: DataFrame, label: str) -> DataFrame:
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )


def class_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """As ``labelled_sample``, with all rows of the rarer class up to half of ``rows``, and a column ``weight``.

    ``weight`` is how many labelled rows a sampled row stands for.
    """
    kept = _labelled(labels, label)
    total = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    few = min(total.get(0, 0), total.get(1, 0), rows // 2)
    bound = {c: few if n == min(total.values()) else rows - few for c, n in total.items()}
    parts = [
        hash_sample(kept.filter(F.col("label") == c), bound[c]).withColumn("weight", F.lit(max(1.0, n / max(1, bound[c]))))
        for c, n in sorted(total.items())
    ]
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else kept.withColumn("weight", F.lit(1.0))


def hash_sample(frame: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of a frame with ``doc_id``."""
    total = frame.count()
    if total <= rows:
        return frame
    return frame.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(_STEPS)) < int(_STEPS * rows / total))


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``(doc_id, label, text)`` and further columns of the sampled rows.  The sample is bounded by its parameter, so it is broadcast."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
