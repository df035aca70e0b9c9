"""Report documents as ordered rows of text.

A report is a table ``(section, k1, k2, k3, k4, text)``; ordering by the keys
gives the document.  Long parts (findings, orphans) stay distributed; only
bounded parts (counts, top lists) are ranked in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.model import SEVERITIES, Profile, profile_of, severity_weight
from riskloom.operators.summary import first_ranked, severity_badge

KEYS = ("section", "k1", "k2", "k3", "k4")
TOP = 10
SHOWN_ORPHANS = 20


def _rows(
    df: DataFrame, section: int, text: Column, k1=0, k2="", k3=0, k4=""
) -> DataFrame:
    def column(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return df.select(
        F.lit(section).alias("section"),
        column(k1, "int").alias("k1"),
        column(k2, "string").alias("k2"),
        column(k3, "int").alias("k3"),
        column(k4, "string").alias("k4"),
        text.alias("text"),
    )


def fixed(spark: SparkSession, section: int, *lines: str, k1: int = -100) -> DataFrame:
    """Constant lines, in the order given."""
    one = spark.range(1)
    numbered = F.posexplode(F.array(*map(F.lit, lines))).alias("n", "line")
    return _rows(one.select(numbered), section, F.col("line"), k1=k1, k3=F.col("n"))


def joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(*KEYS)


# Headings, table heads and empty-state lines of the reports.
LINE_TITLE = "# Source risk report: lines"
SPAN_TITLE = "# Source risk report: spans"
BLOCK_TITLE = "# Source risk report: blocks"
LINE_TABLE = (
    "| Severity | File | Line | Rule | Match |",
    "|----------|------|------|------|-------|",
)
LINE_SECTIONS = {
    "credential": ("## Credential & Secret Findings", "_No credential findings._"),
    "security": ("## Security Vulnerability Findings", "_No security findings._"),
}
DEAD_TABLE = ("| File | Reason |", "|------|--------|")
DEAD_SECTION = ("## Dead / Backup File Findings", "_No dead/backup files found._")
NO_FINDINGS = "_No findings._"
NO_ISSUES = "✅ No issues found."
# The block summary counts the graph entry by its number of values.
BLOCK_GRAPH_VALUES = 5


def head_rows(spark: SparkSession, profile: str | Profile, root: str, generated: str | None = None) -> DataFrame:
    name = profile_of(profile).name
    if name == "line":
        lines = [LINE_TITLE, "", *([f"**Generated:** {generated}"] if generated else [])]
        return fixed(spark, 0, *lines, f"**Project root:** `{root}`", "")
    if name == "span":
        return fixed(spark, 0, SPAN_TITLE, "", f"- Root: `{root}`")
    return fixed(spark, 0, BLOCK_TITLE, "")


def summary_rows(counts: DataFrame, profile: str | Profile) -> DataFrame:
    """Severity counts as a table, most severe first."""
    spark = counts.sparkSession
    name = profile_of(profile).name
    rule = "|----------|-------|" if name == "line" else "|---|---:|"
    row = F.format_string("| %s | %d |", severity_badge(F.col("severity"), profile), "findings")
    return joined(
        fixed(spark, 2, "## Summary", "", "| Severity | Count |", rule),
        _rows(counts, 2, row, k1=-severity_weight(F.col("severity"))),
        fixed(spark, 2, "", k1=100),
    )


def scanner_title(scanner: Column) -> Column:
    return F.initcap(F.concat(scanner, F.lit(" scanner")))


# Fixed order of the scanners in a block report.
BLOCK_ORDER = ("security", "credential", "dead")


def _block_rank(scanner: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BLOCK_ORDER)), scanner)


def scanner_summary_rows(
    findings: DataFrame, scanners: tuple[str, ...], with_graph: bool
) -> DataFrame:
    """Findings per scanner and in total; scanners without findings show 0."""
    spark = findings.sparkSession
    names = F.array(*map(F.lit, scanners)).cast("array<string>")
    wanted = spark.range(1).select(F.explode(names).alias("scanner"))
    counts = wanted.join(
        findings.groupBy("scanner").agg(F.count("*").alias("n")), "scanner", "left"
    ).select("scanner", F.coalesce("n", F.lit(0)).alias("n"))
    extra = BLOCK_GRAPH_VALUES if with_graph else 0
    total = findings.agg((F.count("*") + extra).alias("n"))
    parts = [
        fixed(spark, 2, "## Summary", "", "| Scanner | Findings |", "|---------|----------|"),
        _rows(
            counts,
            2,
            F.format_string("| %s | %d |", scanner_title(F.col("scanner")), "n"),
            k1=_block_rank(F.col("scanner")),
        ),
        _rows(total, 2, F.format_string("| **Total** | **%d** |", "n"), k1=50),
        fixed(spark, 2, "", k1=100),
    ]
    if with_graph:
        parts.append(fixed(spark, 2, f"| Dependency Analysis | {BLOCK_GRAPH_VALUES} |", k1=40))
    return joined(*parts)


def file_stats_rows(stats: DataFrame, profile: str | Profile) -> DataFrame:
    spark = stats.sparkSession
    if profile_of(profile).name == "line":
        return joined(
            fixed(spark, 3, "## File Statistics", ""),
            _rows(stats, 3, F.format_string("- **Custom PHP files scanned:** %d", "custom_files"), k1=1),
            _rows(stats, 3, F.format_string("- **Vendor files excluded:** %d", "vendor_files"), k1=2),
            _rows(stats, 3, F.format_string("- **Total PHP files found:** %d", "total_files"), k1=3),
            fixed(spark, 3, "", k1=4),
        )
    return joined(
        _rows(stats, 1, F.format_string("- Custom PHP files: `%d`", "custom_files"), k1=1),
        _rows(stats, 1, F.format_string("- Vendor PHP files (excluded): `%d`", "vendor_files"), k1=2),
        fixed(spark, 1, "", k1=3),
    )


def finding_rows(findings: DataFrame, profile: str | Profile) -> DataFrame:
    """Detail part of a report, one row of text per finding.

    ``findings`` is read several times and should be materialized.
    """
    name = profile_of(profile).name
    spark = findings.sparkSession
    badge = severity_badge(F.col("severity"), profile)
    weight = -severity_weight(F.col("severity"))
    tie = F.concat_ws("\u0001", "rule", "match")
    if name == "line":
        parts = []
        row = F.format_string(
            "| %s | `%s` | %d | `%s` | `%s` |", badge, "file", "line", "rule", tx.markdown_cell(F.col("match"))
        )
        for section, (scanner, (heading, empty)) in enumerate(LINE_SECTIONS.items(), start=4):
            own = findings.filter(F.col("scanner") == scanner)
            some = own.select(F.lit(1)).limit(1).exists()
            parts += [
                fixed(spark, section, heading, ""),
                fixed(spark, section, *LINE_TABLE, k1=-50).filter(some),
                fixed(spark, section, empty, k1=-50).filter(~some),
                _rows(own, section, row, k1=weight, k2=F.col("file"), k3=F.col("line"), k4=tie),
                fixed(spark, section, "", k1=100),
            ]
        return joined(*parts)
    if name == "span":
        some = findings.select(F.lit(1)).limit(1).exists()
        row = F.format_string(
            "- %s [`%s:%d`](%s#L%d) **%s** (%s): `%s`",
            badge,
            "file",
            "line",
            "file",
            "line",
            "rule",
            F.when(F.col("scanner") == "dead", F.lit("deadfile")).otherwise(F.col("scanner")),
            "match",
        )
        return joined(
            fixed(spark, 8, "## Findings", ""),
            fixed(spark, 8, NO_FINDINGS, "", k1=-50).filter(~some),
            _rows(findings, 8, row, k1=weight, k2=F.col("file"), k3=F.col("line"), k4=tie),
        )
    rank = _block_rank(F.col("scanner"))
    line = F.when(F.col("line") > 0, F.format_string("- **Line:** %d\n", "line")).otherwise(F.lit(""))
    row = F.format_string(
        "### `%s`\n\n- **Severity:** %s %s\n- **File:** `%s`\n%s- **Match:**\n```php\n%s\n```\n",
        "rule",
        "severity",
        badge,
        "file",
        line,
        "match",
    )
    headings = findings.select("scanner").distinct()
    heading = F.format_string("## %s Scanner\n", scanner_title(F.col("scanner")))
    return joined(
        _rows(headings, 5, heading, k1=rank, k3=-1),
        _rows(findings, 5, row, k1=rank, k2=F.col("file"), k3=F.col("line"), k4=tie),
    )


def dead_file_rows(findings: DataFrame) -> DataFrame:
    """File and reason, a section of its own in the line report."""
    spark = findings.sparkSession
    own = findings.filter(F.col("scanner") == "dead")
    some = own.select(F.lit(1)).limit(1).exists()
    heading, empty = DEAD_SECTION
    return joined(
        fixed(spark, 7, heading, ""),
        fixed(spark, 7, *DEAD_TABLE, k1=-50).filter(some),
        fixed(spark, 7, empty, k1=-50).filter(~some),
        _rows(own, 7, F.format_string("| `%s` | %s |", "file", "match"), k2=F.col("file")),
        fixed(spark, 7, "", k1=100),
    )


def graph_rows(
    stats: DataFrame, hubs: DataFrame, orphans: DataFrame, cycles: DataFrame, profile: str | Profile
) -> DataFrame:
    """Include-graph part; ``cycles`` has ``length`` and the array ``cycle``."""
    name = profile_of(profile).name
    spark = stats.sparkSession
    any_cycle = cycles.select(F.lit(1)).limit(1).exists()
    cycle_count = cycles.agg(F.count("*").alias("n"))
    if name == "span":
        return joined(
            fixed(spark, 6, "## Dependency Graph", ""),
            _rows(stats, 6, F.format_string("- Graph: `%d` nodes, `%d` edges", "nodes", "edges"), k1=1),
            fixed(spark, 6, "- Top hubs (in-degree):", k1=2).filter(hubs.exists()),
            _rows(
                hubs,
                6,
                F.format_string("  - `%s`: `%d`", "node", "in_degree"),
                k1=3,
                k3=-F.col("in_degree"),
                k4=F.col("node"),
            ),
            _rows(
                cycle_count.filter("n > 0"), 6, F.format_string("- Cycles detected: `%d`", "n"), k1=4
            ),
            fixed(spark, 6, "", k1=5),
        )
    if name == "block":
        return joined(
            fixed(spark, 6, "## Dependency Analysis Scanner\n"),
            _rows(stats, 6, F.format_string("- **Graph:** %d nodes, %d edges", "nodes", "edges"), k1=1),
            _rows(
                cycle_count.filter("n > 0"), 6, F.format_string("- **Cycles Detected:** %d", "n"), k1=2
            ),
            fixed(spark, 6, "- **Top 5 Hubs (most included files):**", k1=3).filter(hubs.exists()),
            _rows(
                hubs,
                6,
                F.format_string("  - `%s` (score: %d)", "node", "in_degree"),
                k1=4,
                k3=-F.col("in_degree"),
                k4=F.col("node"),
            ),
            fixed(spark, 6, "- **Orphan Files (not included by any other file):**", k1=5).filter(
                orphans.select(F.lit(1)).limit(1).exists()
            ),
            _rows(orphans, 6, F.format_string("  - `%s`", "node"), k1=6, k4=F.col("node")),
            fixed(spark, 6, "", k1=7),
        )
    orphan_count = orphans.agg(F.count("*").alias("n"))
    shown_cycles = first_ranked(cycles, ["length", "cycle"], TOP)
    numbered = F.format_string(
        "%d. %s",
        "rank",
        F.array_join(F.transform("cycle", lambda n: F.concat(F.lit("`"), n, F.lit("`"))), " → "),
    )
    cycle_head = F.format_string("### Circular Dependencies (%d detected)", "n")
    orphan_head = F.format_string("### Orphaned Files (%d files with no incoming includes)", "n")
    more = F.format_string("- _...and %d more_", F.col("n") - SHOWN_ORPHANS)
    return joined(
        fixed(spark, 6, "## Dependency Analysis", ""),
        _rows(stats, 6, F.format_string("- **Nodes (files):** %d", "nodes"), k1=1),
        _rows(stats, 6, F.format_string("- **Edges (include relationships):** %d", "edges"), k1=2),
        fixed(
            spark,
            6,
            "",
            "### Top Included Files (Hubs)",
            "",
            "| File | In-degree |",
            "|------|-----------|",
            k1=3,
        ).filter(hubs.exists()),
        _rows(
            hubs,
            6,
            F.format_string("| `%s` | %d |", "node", "in_degree"),
            k1=4,
            k3=-F.col("in_degree"),
            k4=F.col("node"),
        ),
        fixed(spark, 6, "", k1=5).filter(any_cycle),
        _rows(cycle_count.filter("n > 0"), 6, cycle_head, k1=6),
        fixed(spark, 6, "", k1=7).filter(any_cycle),
        _rows(shown_cycles, 6, numbered, k1=8, k3=F.col("rank")),
        _rows(orphan_count.filter("n > 0"), 6, F.lit(""), k1=9),
        _rows(orphan_count.filter("n > 0"), 6, orphan_head, k1=10),
        _rows(orphan_count.filter("n > 0"), 6, F.lit(""), k1=11),
        _rows(
            orphans.orderBy("node").limit(SHOWN_ORPHANS),
            6,
            F.format_string("- `%s`", "node"),
            k1=12,
            k4=F.col("node"),
        ),
        _rows(orphan_count.filter(F.col("n") > SHOWN_ORPHANS), 6, more, k1=13),
        fixed(spark, 6, "", k1=14),
    )


def failure_rows(spark: SparkSession, failures: dict[str, str]) -> DataFrame:
    """What failed, behind the include-graph part."""
    lines = [f"- **Failed:** {name}: {' '.join(reason.split())}" for name, reason in failures.items()]
    return fixed(spark, 6, *lines, "", k1=15)


def no_issue_rows(findings: DataFrame) -> DataFrame:
    """The one line of a block report without any finding or graph."""
    some = findings.select(F.lit(1)).limit(1).exists()
    return fixed(findings.sparkSession, 4, NO_ISSUES).filter(~some)
