"""The rule pass over arriving files or lines.

The pass is map-only, so the stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.model import Profile
from riskloom.operators.rules import RuleSpec
from riskloom.operators.scan import scan_content, scan_line_rows
from riskloom.streaming.files import arriving_files


def arriving_rows(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a parquet table, a folder or a single file, as they are added.

    The path is given as a pattern, since a stream takes no plain file.
    """
    table = table.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(table).schema).parquet(
        f"{table[:-1]}[{table[-1]}]"
    )


__all__ = ["append_findings", "arriving_files", "arriving_rows", "scan_file_stream", "scan_line_stream", "with_arrival"]


def scan_file_stream(files: DataFrame, profile: str | Profile, floor: str | None = None) -> DataFrame:
    return scan_content(files, profile, floor)


def scan_line_stream(lines: DataFrame, rules: Iterable[RuleSpec]) -> DataFrame:
    """``lines(path, line_no, line)`` through a line rule set."""
    return scan_line_rows(lines, rules)


def append_findings(
    findings: DataFrame, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append findings to a parquet table, exactly once across restarts."""
    writer = (
        findings.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def with_arrival(findings: DataFrame) -> DataFrame:
    return findings.withColumn("found_at", F.current_timestamp())
