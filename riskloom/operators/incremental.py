"""Scans against an earlier snapshot.

A snapshot is a table of paths and digests in buckets by path, sorted within them.  What is compared with it moves as
paths and digests only; contents are read, and kept where they lie, for changed paths alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.paths import is_custom, is_php
from riskloom.model import Profile
from riskloom.operators.summary import filter_min_severity
from riskloom.session import materialize, run_dir
from riskloom.sources import tree

BUCKETS = 64
#: Changed paths that are broadcast, at most; beyond, contents are put into buckets and joined there.
BROADCAST_PATHS = 100_000


def fingerprints(files: DataFrame) -> DataFrame:
    """``(path, digest)``: what a snapshot has to keep of a file."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def _bucketed(table: DataFrame, label: str, buckets: int) -> DataFrame:
    """The table in buckets by path, sorted within them, in the shared folder.  Tasks write their rows as they are."""
    spark = table.sparkSession
    name = f"riskloom_{label}_{uuid.uuid4().hex}"
    writer = table.write.bucketBy(buckets, "path").sortBy("path").format("parquet").option("path", run_dir(spark, label))
    writer.saveAsTable(name)
    return spark.table(name)


def save_snapshot(digests: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``digests(path, digest)`` as a snapshot: later joins by path need no exchange of it.

    The narrow rows are dealt by path first, so that each bucket is one sorted file.
    """
    return _bucketed(digests.select("path", "digest").repartition(buckets, "path"), "snapshot", buckets)


def changed_paths(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``(path, status)``: ``added`` or ``modified``.  ``files`` has contents, or digests already."""
    now = files.select("path", "digest") if "digest" in files.columns else fingerprints(files)
    known = snapshot.select("path", F.col("digest").alias("old_digest"))
    return (
        now.join(known, "path", "left")
        .filter(F.col("old_digest").isNull() | ~F.col("old_digest").eqNullSafe(F.col("digest")))
        .select(
            "path",
            F.when(F.col("old_digest").isNull(), F.lit("added")).otherwise(F.lit("modified")).alias("status"),
        )
    )


def changed_files(
    files: DataFrame, snapshot: DataFrame, buckets: int = BUCKETS, broadcast_paths: int = BROADCAST_PATHS
) -> DataFrame:
    """Files ``(path, content)`` that are new or differ from ``snapshot(path, digest)``.

    Only paths and digests are exchanged.  Up to ``broadcast_paths`` changed paths pick their files by a broadcast;
    more of them meet the contents in buckets by path, into which tasks write the contents they hold.  Either way no
    content goes through an exchange.
    """
    changed = materialize(changed_paths(files, snapshot).select("path").distinct())
    if changed.count() <= broadcast_paths:
        return files.join(F.broadcast(changed), "path", "left_semi")
    stored = _bucketed(files, "files", buckets)
    return stored.join(changed.hint("merge"), "path", "left_semi").select(*files.columns)


def changed_tree(
    spark: SparkSession, root: str, snapshot: DataFrame, profile: str | Profile, units: int | None = None
) -> DataFrame:
    """``(path, content)`` of a tree's project files that are new or differ from the snapshot.

    Tasks digest files where they read them; then only changed files are opened again.  An unreadable file counts as
    changed, with NULL content, so that a scan reports it as skipped.
    """
    listing = tree.list_tree(spark, root, units=units)
    listing = materialize(listing.filter(is_php(F.col("path"), profile) & is_custom(F.col("path"), profile)))
    digests = materialize(tree.digest_contents(listing, root))
    changed = changed_paths(digests, snapshot).select("path")
    return tree.read_contents(listing.join(changed, "path", "left_semi"), root)


def new_findings(findings: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings whose (file, rule, match) did not occur before; lines may move.

    Matches of any length are compared by their SHA-256 digest, so keys are short.
    """
    keys = ["file", "rule", "match_digest"]
    digest = F.sha2(F.col("match"), 256).alias("match_digest")
    before = previous.select("file", "rule", digest).distinct()
    return findings.withColumn("match_digest", digest).join(before, keys, "left_anti").select(*findings.columns)


def gate(findings: DataFrame, floor: str = "HIGH") -> DataFrame:
    """One row ``(blocking, blocked)``: does anything reach the floor?"""
    return (
        filter_min_severity(findings, floor)
        .agg(F.count("*").alias("blocking"))
        .select("blocking", (F.col("blocking") > 0).alias("blocked"))
    )
