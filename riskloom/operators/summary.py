"""Filters, counts, orderings and limits over findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.paths import is_custom, is_php
from riskloom.model import SEVERITIES, Profile, profile_of, severity_weight, weight_of
from riskloom.session import materialize

# Scanners by mode.
MODES = {
    "security": ("credential", "security"),
    "deps": (),
    "dead": ("dead",),
    "all": ("credential", "security", "dead"),
}
BLOCK_MODES = {**MODES, "security": ("security",), "credential": ("credential",)}


def modes_of(profile: str | Profile) -> dict[str, tuple[str, ...]]:
    return BLOCK_MODES if profile_of(profile).name == "block" else MODES


def filter_min_severity(findings: DataFrame, floor: str) -> DataFrame:
    return findings.filter(severity_weight(F.col("severity")) >= weight_of(floor))


def select_scanners(findings: DataFrame, mode: str, profile: str | Profile) -> DataFrame:
    modes = modes_of(profile)
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(modes)}")
    return findings.filter(F.col("scanner").isin(*modes[mode]))


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_table(findings: DataFrame) -> DataFrame:
    """``(severity, weight)``: the five levels."""
    levels = [
        F.struct(F.lit(name).alias("severity"), F.lit(weight).alias("weight"))
        for name, weight in SEVERITIES.items()
    ]
    return findings.sparkSession.range(1).select(F.inline(F.array(*levels)))


def count_by_severity(findings: DataFrame, scanners: tuple[str, ...] | None = None) -> DataFrame:
    """``(severity, findings)``: all five levels, zeros included.

    A missing severity counts as INFO.
    """
    if scanners is not None:
        findings = findings.filter(F.col("scanner").isin(*scanners))
    counted = findings.groupBy(F.coalesce("severity", F.lit("INFO")).alias("severity")).agg(
        F.count("*").alias("n")
    )
    # At most one row per severity name on the right side.
    return (
        severity_table(findings)
        .join(counted, "severity", "left")
        .select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))
    )


def count_by_scanner(findings: DataFrame) -> DataFrame:
    """``(scanner, findings)`` with a grand total in the row ``total``.

    Counts findings only; the include graph is no scanner here.
    """
    return (
        findings.rollup("scanner")
        .agg(F.count("*").alias("findings"), F.grouping("scanner").alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, F.lit("total")).otherwise(F.col("scanner")).alias("scanner"),
            "findings",
        )
    )


def scanner_finding_counts(findings: DataFrame, floor: str) -> DataFrame:
    """``(scanner, findings)`` at or above the floor."""
    return filter_min_severity(findings, floor).groupBy("scanner").agg(F.count("*").alias("findings"))


def file_stats(listing: DataFrame, profile: str | Profile, root: str | None = None) -> DataFrame:
    """One row ``(custom_files, vendor_files, total_files)`` in one pass."""
    php = listing.filter(is_php(F.col("path"), profile))
    custom = is_custom(F.col("path"), profile, root)
    return php.agg(
        F.count_if(custom).alias("custom_files"),
        F.count_if(~custom).alias("vendor_files"),
        F.count("*").alias("total_files"),
    )


def sort_keys(profile: str | Profile) -> list[Column]:
    """Severity, file, line; the block profile ignores severity.  Rule and match
    make the order total."""
    keys = [F.col("file"), F.col("line"), F.col("rule"), F.col("match")]
    if profile_of(profile).name == "block":
        return keys
    return [F.desc(severity_weight(F.col("severity"))), *keys]


def sort_findings(findings: DataFrame, profile: str | Profile) -> DataFrame:
    return findings.orderBy(*sort_keys(profile))


def numbered(df: DataFrame, keys: list) -> DataFrame:
    """All rows with their 1-based ``place`` in the order of ``keys``, without gathering them in one task.

    The sort's ranges are written with the place within each range; ranges are then offset by the counts of those
    before them, one row for each range.  Ties take any order, so let the keys be total.
    """
    ranges = df.orderBy(*keys).select(
        "*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")
    )
    ranges = materialize(ranges)
    counts = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = ranges.join(F.broadcast(offsets), "__range")
    return placed.select((F.col("__before") + F.col("__at") + 1).alias("place"), *df.columns)


def first_ranked(df: DataFrame, keys: list, n: int, total: str = "total") -> DataFrame:
    """The first ``n`` rows with a 1-based ``rank`` and the overall row count.

    Only the n rows that survive the distributed top-n are ranked in one place.
    ``df`` is read twice and should be materialized.
    """
    top = df.orderBy(*keys).limit(n)
    counted = df.agg(F.count("*").alias("n")).scalar()
    return top.select(
        F.row_number().over(W.orderBy(*keys)).alias("rank"), "*", counted.alias(total)
    )


def deduplicate(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def finding_record(findings: DataFrame) -> DataFrame:
    """``(record)``: each finding as a JSON object."""
    return findings.select(
        F.to_json(F.struct("file", "line", "rule", "severity", "match")).alias("record")
    )


def finding_display(findings: DataFrame) -> DataFrame:
    """``(display)``: ``[SEVERITY] file:line (rule): 'match'``."""
    return findings.select(
        F.format_string(
            "[%s] %s:%d (%s): %s", "severity", "file", "line", "rule", tx.quoted(F.col("match"))
        ).alias("display")
    )


# How each profile shows a severity.
LINE_BADGES = {
    "CRITICAL": "🔴 CRITICAL",
    "HIGH": "🟠 HIGH",
    "MEDIUM": "🟡 MEDIUM",
    "LOW": "🔵 LOW",
    "INFO": "⚪ INFO",
}
BLOCK_COLORS = {"HIGH": "orange", "MEDIUM": "yellow", "LOW": "blue", "INFO": "blue"}
BLOCK_OTHER_COLOR = "red"


def severity_badge(severity: Column, profile: str | Profile) -> Column:
    name = profile_of(profile).name
    if name == "span":
        return F.concat(F.lit("`"), severity, F.lit("`"))
    if name == "line":
        shown = severity
        for level, badge in LINE_BADGES.items():
            shown = F.when(severity == level, F.lit(badge)).otherwise(shown)
        return shown
    color = F.lit(BLOCK_OTHER_COLOR)
    for level, value in BLOCK_COLORS.items():
        color = F.when(severity == level, F.lit(value)).otherwise(color)
    return F.format_string("![%s](https://img.shields.io/badge/severity-%s-%s)", severity, severity, color)
