"""A whole analysis: findings, file statistics, include graph, reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from riskloom.model import FINDING_DDL, Profile, profile_of, weight_of
from riskloom.operators import deadfiles, graph, includes, onepass, summary
from riskloom.operators.rules import CREDENTIALS, security_rules
from riskloom.plans import document
from riskloom.plans import report as rp
from riskloom.session import materialize
from riskloom.sources import jsondoc, sinks, tree


@dataclass
class Analysis:
    """Result tables of one run; the graph ones are None when not asked for, or when their search failed.

    ``skipped(path, reason)`` are files whose contents could not be read; it is None when no contents were asked for.
    ``counts`` are of the one read of the contents: files, bytes, skipped files.  ``failures`` names what failed;
    ``whole`` gives only a run without any.
    """

    profile: Profile
    mode: str
    findings: DataFrame
    stats: DataFrame
    skipped: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    graph_stats: DataFrame | None = None
    hubs: DataFrame | None = None
    orphans: DataFrame | None = None
    cycles: DataFrame | None = None

    def whole(self) -> Analysis:
        """This run, if nothing of it failed; else an error that names what did."""
        if self.failures:
            raise RuntimeError("; ".join(f"{name} failed: {reason}" for name, reason in self.failures.items()))
        return self

    def tables(self) -> dict[str, DataFrame]:
        failed = None
        if self.failures:
            failed = self.findings.sparkSession.createDataFrame([*self.failures.items()], "name string, reason string")
        named = {
            "findings": self.findings,
            "stats": self.stats,
            "skipped": self.skipped,
            "graph_stats": self.graph_stats,
            "hubs": self.hubs,
            "orphans": self.orphans,
            "cycles": self.cycles,
            "failures": failed,
        }
        return {name: table for name, table in named.items() if table is not None}


def analyze(
    files: DataFrame,
    profile: str | Profile = "line",
    mode: str = "all",
    severity: str = "HIGH",
    listing: DataFrame | None = None,
    root: str | None = None,
) -> Analysis:
    """Analyse ``files(path, content)`` with root-relative paths.

    ``listing(path)`` is the unfiltered tree when ``files`` holds only project files.  Findings, include paths and
    skipped files come out of one read of the contents, which mode ``dead`` does without.  A cycle search that fails
    leaves all other results; it is named in ``failures``, in reports and in documents.
    """
    prof = profile_of(profile)
    weight_of(severity)
    modes = summary.modes_of(prof)
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(modes)}")
    listing = files.select("path") if listing is None else listing.select("path")
    rules = [r for r in (*CREDENTIALS, *security_rules(prof)) if r.scanner in modes[mode]]
    with_graph = mode in ("deps", "all")
    contents = onepass.read_once(files, rules, prof, severity, with_graph) if rules or with_graph else None
    parts = [contents.findings] if rules else []
    if "dead" in modes[mode]:
        floor = severity if prof.dead_uses_floor else None
        parts.append(materialize(deadfiles.scan_names(listing, prof, floor)))
    if parts:
        findings = summary.union_findings(*parts)
    else:
        findings = files.sparkSession.createDataFrame([], FINDING_DDL)
    result = Analysis(prof, mode, findings, summary.file_stats(listing, prof))
    if contents is not None:
        result.skipped, result.counts = contents.skipped, contents.counts
    if with_graph:
        nodes = materialize(includes.include_nodes(listing, prof))
        edges = materialize(includes.edges_from(contents.includes, listing, prof, root))
        result.graph_stats = graph.graph_stats(nodes, edges)
        result.hubs = graph.top_hubs(nodes, edges)
        result.orphans = graph.orphan_files(nodes, edges, prof).orderBy("node")
        try:
            result.cycles = graph.include_cycles(edges).orderBy("length", "cycle")
        except Exception as failure:  # the search may be too much for any cluster; the rest stands
            result.failures["cycles"] = str(failure)
    return result


def markdown(result: Analysis, root: str, generated: str | None = None) -> DataFrame:
    """The profile's report document as ordered rows of text."""
    prof, findings = result.profile, result.findings
    spark = findings.sparkSession
    parts = [rp.head_rows(spark, prof, root, generated)]
    if prof.name == "block":
        ran = summary.modes_of(prof)[result.mode]
        ran = tuple(s for s in rp.BLOCK_ORDER if s in ran)
        parts.append(rp.scanner_summary_rows(findings, ran, result.hubs is not None))
        if result.hubs is None:
            parts.append(rp.no_issue_rows(findings))
    else:
        counted = ("credential", "security") if prof.name == "line" else None
        parts.append(rp.summary_rows(summary.count_by_severity(findings, counted), prof))
        parts.append(rp.file_stats_rows(result.stats, prof))
    parts.append(rp.finding_rows(findings, prof))
    if result.hubs is not None:
        # Report parts read the graph tables several times.
        none = spark.createDataFrame([], "length int, cycle array<string>")
        parts.append(
            rp.graph_rows(
                result.graph_stats,
                materialize(result.hubs),
                materialize(result.orphans),
                materialize(result.cycles) if result.cycles is not None else none,
                prof,
            )
        )
    if result.failures:
        parts.append(rp.failure_rows(spark, result.failures))
    if prof.name == "line":
        parts.append(rp.dead_file_rows(findings))
    return rp.ordered(rp.joined(*parts))


def write_document(result: Analysis, root: str, output: str, generated: str | None = None) -> None:
    """The whole run as one JSON file: findings, counts, graph, skipped files, root and time."""
    prof = result.profile
    sizes = None
    if result.graph_stats is not None:
        row = result.graph_stats.first()
        sizes = (row["nodes"], row["edges"])
    ran = document.scanners_of(prof, result.mode)
    layout = document.layout_of(prof, ran, sizes is not None, root, generated, sizes)
    if result.failures:
        layout["failures"] = result.failures
    rows = document.document_rows(
        prof, result.findings, result.stats, result.skipped, result.hubs, result.orphans, result.cycles
    )
    jsondoc.write_document(rows, layout, output)


def run_job(
    spark: SparkSession,
    root: str,
    profile: str = "line",
    mode: str = "all",
    severity: str = "HIGH",
    output: str = "report",
    fmt: str = "md",
) -> Analysis:
    """List, read and analyse a tree and write ``output.md`` and/or ``output.json`` and ``output.document.json``.

    The first two are folders of parts; the third is one file with the same tables, the root and the time.  A run of
    which a part failed is an error once all else is written.
    """
    if fmt not in ("md", "json", "both"):
        raise ValueError(f"unknown format {fmt!r}, expected md, json or both")
    _, base = tree.Place.of(root).open()
    listing, files = tree.read_project(spark, root, profile)
    result = analyze(files, profile, mode, severity, listing, base)
    now = datetime.now()
    if fmt in ("md", "both"):
        sinks.write_markdown(markdown(result, base, now.strftime("%Y-%m-%d %H:%M:%S")), f"{output}.md")
    if fmt in ("json", "both"):
        sinks.write_json(result.tables(), f"{output}.json")
        write_document(result, base, f"{output}.document.json", now.isoformat())
    return result.whole()
