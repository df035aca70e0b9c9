"""Report sinks.  Tables are written in parts by the tasks that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(tables: dict[str, DataFrame], output: str) -> None:
    """One JSON-lines table per entry below ``output``; findings by scanner."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if name == "findings":
            writer = writer.partitionBy("scanner")
        writer.json(f"{output}/{name}")


def write_markdown(report: DataFrame, output: str) -> None:
    """Report rows as text parts; the parts in name order are the document."""
    report.select("text").write.mode("overwrite").text(output)
