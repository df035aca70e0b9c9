"""The training-data pipeline over ``documents``: reject, cut repeated lines, keep one of each group, clean, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``,
whatever else these are.  Tables without rows give tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, linededup, neardup, packing, quality
from riskloom.llm.common import flag_among, table
from riskloom.llm.queries import TOKENIZER
from riskloom.session import materialize

#: Documents below this quality score are rejected; uncertain ones stay.
REJECT_BELOW = 0.5
#: Near duplicates share this percentage of their runs of so many words; bands are set for that similarity.
PERCENT, SHINGLE, BANDS, ROWS = 80, 5, 36, 5

#: What a worker keeps of units encoded before; it shares its memory with what earlier stages left.
CACHE_BYTES = 48 << 20


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels all stay.  Null texts count as empty."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_score(F.col("text"), model) >= REJECT_BELOW)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which only blank lines are left goes.

    ``n_chars`` follows the text where lines were cut.
    """
    found = linededup.dedup_lines(docs, prefix="__")
    cut = F.col("__lines_deleted") > 0
    found = found.filter(~cut | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; null ids stay."""
    groups = neardup.near_duplicates(docs, PERCENT, SHINGLE, BANDS, ROWS)
    gone = materialize(groups.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    # Documents that surely stay do not move.
    key = F.col("doc_id").cast("long")
    flagged = flag_among(docs, key, gone, F.col("__gone"), "__maybe")
    checked = flagged.filter("__maybe").join(gone, key == F.col("__gone"), "left_anti")
    return checked.unionAll(flagged.filter("NOT __maybe")).drop("__maybe")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.without_copies(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER, cache_bytes=CACHE_BYTES)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

# Models, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
