"""One read of all contents: findings, include paths and skipped files as one tagged table.

Contents are read once however many outputs a run needs.  Rows are those of findings; ``kind`` tells them apart and
partitions the written table, so that reading one kind back reads nothing of the others.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.model import FINDING_COLUMNS, FINDING_DDL, Profile, profile_of
from riskloom.operators import scan
from riskloom.operators.includes import raw_includes
from riskloom.operators.rules import RuleSpec, at_least, is_exotic
from riskloom.session import run_dir

FINDING, INCLUDE, SKIPPED = "finding", "include", "skipped"
_OTHERS = "array<struct<scanner:string,line:int,rule:string,severity:string,match:string>>"


@dataclass
class Contents:
    """What one read of the contents gave; ``counts`` are of that read: files, bytes, and skipped files."""

    findings: DataFrame
    includes: DataFrame
    skipped: DataFrame
    counts: dict[str, int]


def tagged_rows(
    files: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile, floor: str | None = None, with_includes: bool = True
) -> DataFrame:
    """``(kind, scanner, file, line, rule, severity, match)`` of the profile's project files, map-only.

    An include's path is its ``match``, a skipped file's reason its ``rule``; neither has a severity.
    """
    prof = profile_of(profile)
    texts = scan.opened(scan.custom_files(files, prof), prof)
    kept = at_least(rules, floor)
    others = _others(prof.name, with_includes)
    rows = _line_rows(texts, kept, others) if prof.name == "line" else scan.text_rows(texts, kept, prof, others)
    kind = F.when(F.col("scanner").isin(INCLUDE, SKIPPED) & F.col("severity").isNull(), F.col("scanner"))
    return rows.select(F.coalesce(kind, F.lit(FINDING)).alias("kind"), *FINDING_COLUMNS)


def _others(profile: str, with_includes: bool) -> Column:
    def row(scanner: str, rule: Column, match: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(scanner).alias("scanner"), F.lit(None).cast("int").alias("line"), rule.alias("rule"), none.alias("severity"), match.alias("match")
        )

    none = F.array().cast(_OTHERS)
    skipped = F.when(F.col("skipped").isNotNull(), F.array(row(SKIPPED, F.col("skipped"), F.lit(None).cast("string"))))
    if not with_includes:
        return F.coalesce(skipped, none)
    raws = F.array_distinct(raw_includes(F.col("text"), profile))
    return F.coalesce(skipped, F.transform(raws, lambda raw: row(INCLUDE, F.lit(None).cast("string"), raw)), none)


def _line_rows(texts: DataFrame, rules: tuple[RuleSpec, ...], others: Column) -> DataFrame:
    """Each text gives one row for its other outputs and one for each of its lines."""
    line, low, exotic = F.col("line"), F.col("low"), F.col("exotic")
    parts = texts.select("path", "text", "skipped", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    is_text = F.col("part") == 0
    nothing = F.array(F.lit(None).cast("string"))
    prepared = parts.select(
        "path",
        F.when(is_text, tx.split_lines(F.col("text"))).otherwise(nothing).alias("line"),
        F.when(is_text, tx.split_lines(F.lower("text"))).otherwise(nothing).alias("low"),
        F.when(is_text, is_exotic(F.col("text"))).alias("exotic"),
        F.when(~is_text, others).alias("others"),
    )
    prepared = prepared.filter("others is null or size(others) > 0")
    lines = prepared.select("path", "exotic", "others", F.posexplode(F.arrays_zip("line", "low")).alias("pos", "both"))
    lines = lines.select("path", "exotic", "others", (F.col("pos") + 1).alias("line_no"), "both.line", "both.low")
    possible = F.lit(False)
    hits = []
    for rule in rules:
        possible = possible | rule.possible(low, exotic)
        tag = F.struct(
            F.lit(rule.scanner).alias("scanner"),
            F.col("line_no").alias("line"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.severity).alias("severity"),
            F.lit(None).cast("string").alias("match"),
        )
        hits.append(F.when(rule.possible(low, exotic) & rule.hits(line), tag))
    found = F.array_compact(F.array(*hits)).cast(_OTHERS) if hits else F.array().cast(_OTHERS)
    lines = lines.filter(F.col("others").isNotNull() | possible)
    return lines.select("path", F.col("line").alias("raw_line"), F.inline(F.coalesce("others", found))).select(
        "scanner",
        F.col("path").alias("file"),
        "line",
        "rule",
        "severity",
        F.when(F.col("severity").isNull(), F.col("match")).otherwise(tx.strip(F.col("raw_line"))).alias("match"),
    )


def read_once(
    files: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile, floor: str | None = None, with_includes: bool = True
) -> Contents:
    """Read the contents, write the tagged rows once, and give back each kind as a table of its own."""
    spark = files.sparkSession
    read = Observation("contents")
    size = F.length("content") if files.schema["content"].dataType.typeName() == "binary" else F.octet_length("content")
    custom = scan.custom_files(files, profile).observe(
        read, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    )
    folder = run_dir(spark, "contents")
    tagged_rows(custom, rules, profile, floor, with_includes).write.partitionBy("kind").parquet(folder)
    rows = spark.read.schema(FINDING_DDL + ", kind string").parquet(folder)
    skipped = rows.filter(F.col("kind") == SKIPPED).select(F.col("file").alias("path"), F.col("rule").alias("reason"))
    return Contents(
        rows.filter(F.col("kind") == FINDING).select(*FINDING_COLUMNS),
        rows.filter(F.col("kind") == INCLUDE).select(F.col("file").alias("src"), F.col("match").alias("raw")),
        skipped,
        {**read.get, "skipped": skipped.count()},
    )
