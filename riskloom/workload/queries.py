"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import paths as px
from riskloom.functions import text as tx
from riskloom.model import PROFILES, severity_weight
from riskloom.operators import (
    deadfiles,
    graph,
    incremental,
    includes,
    onepass,
    rules,
    scan,
    summary,
    taint,
)
from riskloom.plans import analyze as plan
from riskloom.plans import report as rp
from riskloom.session import materialize, run_dir
from riskloom.sources import jsondoc, sinks, tree
from riskloom.streaming import scan as streaming
from riskloom.workload import corpus
from riskloom.workload.corpus import source_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The earlier state of the tree that incremental queries compare with.
SNAPSHOT_DATE = "2000-06-01 00:00:00"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn

    return register


def per_profile(template: str, profiles=tuple(PROFILES)):
    """Register ``f(spark, sf_dir, profile)`` once per profile."""

    def register(fn):
        for profile in profiles:
            query(template.format(profile))(lambda s, d, p=profile: fn(s, d, p))
        return fn

    return register


def listing_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).select("path")


def texts_of(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    return scan.decoded(scan.custom_files(files, profile), profile)


def all_findings(
    spark: SparkSession, sf_dir: str, profile: str, floor: str | None = None, mode: str = "all"
) -> DataFrame:
    """Content and file-name findings of a profile, each with its own floor rule.

    A mode chooses rules before anything is planned, so contents that no chosen rule looks at are not read.
    """
    files = source_files(spark, sf_dir)
    scanners = summary.modes_of(profile)[mode]
    chosen = [r for r in (*rules.CREDENTIALS, *rules.security_rules(profile)) if r.scanner in scanners]
    parts = [scan.apply_rules(files, chosen, profile, floor)] if chosen else []
    if "dead" in scanners:
        floor = floor if PROFILES[profile].dead_uses_floor else None
        parts.append(deadfiles.scan_names(files.select("path"), profile, floor))
    return summary.union_findings(*parts)


# ---------------------------------------------------------------- filters


@per_profile("filter_vendor_{}")
def _(spark, sf_dir, profile):
    return listing_of(spark, sf_dir).filter(px.is_custom(F.col("path"), profile))


@query("filter_vendor_hidden_alias")
def _(spark, sf_dir):
    """Vendor for the span profile only: the alias through leading dots."""
    path = F.col("path")
    return listing_of(spark, sf_dir).filter(px.is_vendor(path, "span") & ~px.is_vendor(path, "line"))


@per_profile("filter_outside_root_{}")
def _(spark, sf_dir, profile):
    """The tree seen from the root ``app``: most paths lie outside of it."""
    absolute = F.concat(F.lit("/srv/"), "path")
    listing = listing_of(spark, sf_dir).select(absolute.alias("path"))
    return listing.filter(px.is_custom(F.col("path"), profile, "/srv/app"))


@per_profile("filter_extension_{}", ("line", "block"))
def _(spark, sf_dir, profile):
    return listing_of(spark, sf_dir).filter(px.is_php(F.col("path"), profile))


@per_profile("filter_min_severity_{}", ("line", "block"))
def _(spark, sf_dir, profile):
    return all_findings(spark, sf_dir, profile, "HIGH")


@query("sanitizer_veto")
def _(spark, sf_dir):
    """Lines with a request value that a sanitizer keeps from being reported."""
    lines = scan.numbered_lines(texts_of(spark, sf_dir, "line"))
    line = F.col("line")
    return lines.filter(F.contains(line, F.lit("$_")) & rules.has_token(line, rules.SANITIZERS))


@query("sanitized_rhs")
def _(spark, sf_dir):
    """Assignments from request values and whether they taint their variable."""
    lines = scan.numbered_lines(texts_of(spark, sf_dir, "span"))
    rhs = F.regexp_extract("line", taint.ASSIGNMENT, 2)
    return (
        lines.select("path", "line_no", rhs.alias("rhs"))
        .filter(F.rlike("rhs", F.lit(rules.SUPERGLOBAL)))
        .withColumn("sanitized", ~taint.is_tainting(F.col("rhs")))
    )


@query("select_scanners")
def _(spark, sf_dir):
    return summary.select_scanners(all_findings(spark, sf_dir, "span", mode="dead"), "dead", "span")


# ------------------------------------------------------------ projections


@query("relpath")
def _(spark, sf_dir):
    path = F.concat(F.lit("/srv/"), F.col("path"))
    listing = listing_of(spark, sf_dir).select(path.alias("path"))
    return listing.select(
        "path",
        px.relative_path(F.col("path"), "/srv/app").alias("relpath"),
        px.relative_path(F.col("path"), "/srv/app", "name").alias("display"),
    )


@query("split_lines")
def _(spark, sf_dir):
    return scan.numbered_lines(texts_of(spark, sf_dir, "line"))


@query("normalize_newlines")
def _(spark, sf_dir):
    """Texts before and after: carriage returns left and line feeds found."""
    files = source_files(spark, sf_dir)
    text = tx.normalize_newlines(F.col("content"))
    return files.select(
        "path",
        F.regexp_count("content", F.lit("\r")).cast("long").alias("returns_before"),
        F.regexp_count(text, F.lit("\r")).cast("long").alias("returns_after"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("feeds_after"),
    )


@query("offset_to_line")
def _(spark, sf_dir):
    """Line of every link in the raw web pages, over their whole text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hits = scan.pattern_hits(tx.normalize_newlines(F.col("html")), "</(?:p|li|h1)>\\s*<")
    return pages.select("page_id", F.posexplode(hits).alias("match_no", "hit")).select(
        "page_id", "match_no", F.col("hit.line").alias("line"), F.col("hit.match").alias("match")
    )


@query("shorten")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.shorten(F.col("text")).alias("short"))


@query("md_cell")
def _(spark, sf_dir):
    findings = scan.scan_security(source_files(spark, sf_dir), "line")
    return findings.select("file", "line", "rule", tx.markdown_cell(F.col("match")).alias("cell"))


@per_profile("severity_badge_{}")
def _(spark, sf_dir, profile):
    findings = deadfiles.scan_names(listing_of(spark, sf_dir), profile)
    return findings.select(
        "file",
        "rule",
        summary.severity_badge(F.col("severity"), profile).alias("badge"),
        severity_weight(F.col("severity")).alias("weight"),
    )


@query("finding_to_record")
def _(spark, sf_dir):
    findings = scan.scan_security(source_files(spark, sf_dir), "span")
    record = F.from_json("record", "file string, line int, rule string, severity string, match string")
    return summary.finding_record(findings).select(record.alias("r")).select("r.*")


@query("finding_display")
def _(spark, sf_dir):
    return summary.finding_display(scan.scan_security(source_files(spark, sf_dir), "line"))


# ------------------------------------------------------------------ rules


def _single_rule(rule: str, profile: str) -> Query:
    def run(spark, sf_dir):
        chosen = [r for r in rules.security_rules(profile) if r.name == rule]
        return scan.apply_rules(source_files(spark, sf_dir), chosen, profile)

    return run


for _rule in (
    "sql_injection",
    "eval_usage",
    "xss_direct_echo",
    "dynamic_include",
    "shell_exec",
    "open_redirect",
):
    for _profile in PROFILES:
        query(f"sec_{_rule}_{_profile}")(_single_rule(_rule, _profile))


@per_profile("scan_security_all_{}")
def _(spark, sf_dir, profile):
    return scan.scan_security(source_files(spark, sf_dir), profile)


@query("tainted_vars")
def _(spark, sf_dir):
    return taint.tainted_vars_table(texts_of(spark, sf_dir, "span"))


@query("query_calls")
def _(spark, sf_dir):
    return taint.query_calls_table(texts_of(spark, sf_dir, "span"))


@query("sqli_taint")
def _(spark, sf_dir):
    """Calls that taint reaches, with the full snippet."""
    texts = texts_of(spark, sf_dir, "span")
    return texts.select("path", F.inline(taint.tainted_calls(F.col("text"))))


def _credential_rule(rule: str) -> Query:
    def run(spark, sf_dir):
        chosen = [r for r in rules.CREDENTIALS if r.name == rule]
        return scan.apply_rules(source_files(spark, sf_dir), chosen, "line")

    return run


for _key, _rule in (
    ("cred_hardcoded_db_password", "hardcoded_db_password"),
    ("cred_define_secret", "define_secret"),
    ("cred_hardcoded_assignment", "hardcoded_assignment"),
    ("cred_base64_key", "base64_encoded_key"),
):
    query(_key)(_credential_rule(_rule))


@per_profile("scan_credentials_{}", ("span", "block"))
def _(spark, sf_dir, profile):
    return scan.scan_credentials(source_files(spark, sf_dir), profile)


@query("cred_assignment_documents")
def _(spark, sf_dir):
    """Assignments of secrets in prose, over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    return scan.run_rules(texts, [rules.PLAIN_ASSIGNMENT], "span")


@query("leak_patterns")
def _(spark, sf_dir):
    files = source_files(spark, sf_dir).filter(scan.is_leak_candidate(F.col("path")))
    return scan.run_rules(scan.decoded(files, "span"), rules.LEAKS, "span")


@query("leak_allowlist")
def _(spark, sf_dir):
    files = source_files(spark, sf_dir).filter(scan.is_leak_candidate(F.col("path")))
    return scan.scan_leaks(scan.decoded(files, "span"))


@query("leak_patterns_documents")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan.scan_leaks(docs.select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("custom_rules")
def _(spark, sf_dir):
    """A user's own rules through the same pass."""
    own = [
        rules.RuleSpec("curl_call", "LOW", (r"\bcurl_\w+\s*\(",), keywords=("curl_",), scanner="own"),
        rules.RuleSpec(
            "cookie_read", "INFO", (r"\$_COOKIE\b",), veto=("htmlspecialchars",), scanner="own"
        ),
    ]
    return scan.apply_rules(source_files(spark, sf_dir), own, "line")


# Several patterns in one rule, matches over several lines, and words that cancel a match on any line it touches.
OWN_TEXT_RULES = (
    rules.RuleSpec("outside_call", "MEDIUM", (r"\bcurl_\w+\s*\(", r"\b(?:shell_)?exec\s*\("), scanner="own"),
    rules.RuleSpec(
        "request_read", "INFO", (r"\$_(?:GET|POST)\s*\[[^\]]*\]", r"\$_COOKIE\b"), veto=("htmlspecialchars", "intval"), scanner="own"
    ),
    rules.RuleSpec("query_statement", "LOW", (r"->query\([^;]*", r"->execute\("), veto=("some_long_table_name", "delete"), scanner="own"),
)


@per_profile("custom_rules_{}", ("span", "block"))
def _(spark, sf_dir, profile):
    """A user's own rules over whole texts."""
    return scan.apply_rules(source_files(spark, sf_dir), OWN_TEXT_RULES, profile)


# ---------------------------------------------------------- skipped files


def _with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with no content for every fifth file (by length)."""
    files = source_files(spark, sf_dir)
    return files.select("path", F.when(F.length("content") % 5 != 0, F.col("content")).alias("content"))


@per_profile("skipped_files_{}")
def _(spark, sf_dir, profile):
    """Project files that could not be read, or are no text to a strict profile, each with the reason."""
    files = _with_missing(spark, sf_dir)
    return scan.skipped_files(files.select("path", _broken_bytes(F.col("content")).alias("content")), profile)


@per_profile("one_pass_{}")
def _(spark, sf_dir, profile):
    """Findings, include paths and skipped files out of one read of the contents."""
    chosen = (*rules.CREDENTIALS, *rules.security_rules(profile))
    contents = onepass.read_once(_with_missing(spark, sf_dir), chosen, profile)
    found = contents.findings.select(F.lit("finding").alias("kind"), "file", "line", "rule", "severity", "match")
    none = F.lit(None).cast("string")
    included = contents.includes.select(
        F.lit("include").alias("kind"), F.col("src").alias("file"), none.cast("int").alias("line"), none.alias("rule"), none.alias("severity"), F.col("raw").alias("match")
    )
    skipped = contents.skipped.select(
        F.lit("skipped").alias("kind"), F.col("path").alias("file"), none.cast("int").alias("line"), F.col("reason").alias("rule"), none.alias("severity"), none.alias("match")
    )
    return found.unionByName(included).unionByName(skipped)


# ------------------------------------------------------------- dead files


@query("dead_first_reason")
def _(spark, sf_dir):
    return deadfiles.scan_names(listing_of(spark, sf_dir), "line")


@query("dead_all_reasons")
def _(spark, sf_dir):
    return deadfiles.scan_names(listing_of(spark, sf_dir), "span")


@query("dead_multi_rule")
def _(spark, sf_dir):
    return deadfiles.scan_names(listing_of(spark, sf_dir), "block")


@query("wp_context_root")
def _(spark, sf_dir):
    """The subtree ``lib`` as its own root; it holds a wp-admin directory."""
    listing = listing_of(spark, sf_dir).filter(px.is_under(F.col("path"), "lib"))
    inside = listing.select(px.relative_path(F.col("path"), "lib").alias("path"))
    return deadfiles.scan_names(inside, "span")


@query("wp_context_sibling")
def _(spark, sf_dir):
    return deadfiles.wordpress_dirs(listing_of(spark, sf_dir))


# ---------------------------------------------------------- include graph


def _includes(spark, sf_dir, profile):
    return includes.extract_includes(texts_of(spark, sf_dir, profile), profile)


def _graph(spark, sf_dir, profile):
    files = source_files(spark, sf_dir)
    nodes = includes.include_nodes(files.select("path"), profile)
    return nodes, includes.include_edges(files, profile)


@query("extract_includes_line")
def _(spark, sf_dir):
    texts = texts_of(spark, sf_dir, "line")
    raws = includes.literal_includes(F.col("text"))
    return texts.select(F.col("path").alias("src"), F.explode(raws).alias("raw"))


@query("extract_includes_dir")
def _(spark, sf_dir):
    texts = texts_of(spark, sf_dir, "line")
    raws = includes.dir_includes(F.col("text"))
    return texts.select(F.col("path").alias("src"), F.explode(raws).alias("raw"))


@query("extract_includes_stmt")
def _(spark, sf_dir):
    texts = texts_of(spark, sf_dir, "span")
    raws = includes.statement_includes(F.col("text"))
    return texts.select(F.col("path").alias("src"), F.explode(raws).alias("raw"))


@query("extract_includes_block")
def _(spark, sf_dir):
    texts = texts_of(spark, sf_dir, "block")
    raws = includes.block_includes(F.col("text"))
    return texts.select(F.col("path").alias("src"), F.explode(raws).alias("raw"))


@query("normalize_path")
def _(spark, sf_dir):
    """Include paths joined to the including directory and folded."""
    found = _includes(spark, sf_dir, "line")
    joined = F.concat(px.parent(F.col("src")), F.lit("/./"), F.ltrim("raw", F.lit("/")))
    return found.select("src", "raw", px.normalize_path(joined).alias("folded"))


@per_profile("resolve_includes_{}")
def _(spark, sf_dir, profile):
    return includes.resolve_includes(
        _includes(spark, sf_dir, profile), listing_of(spark, sf_dir), profile
    )


@per_profile("include_edges_{}")
def _(spark, sf_dir, profile):
    return _graph(spark, sf_dir, profile)[1]


@per_profile("include_nodes_{}")
def _(spark, sf_dir, profile):
    return includes.include_nodes(listing_of(spark, sf_dir), profile)


# The file that every block head includes.
HUB = "lib/f5.PHP"
SUCCESSORS_OF = "app/admin/f180.php"


@query("edge_lookup")
def _(spark, sf_dir):
    """Predecessors of the common hub, each checked to be an edge."""
    edges = _graph(spark, sf_dir, "line")[1]
    return edges.filter(F.col("dst") == HUB).select("src", "dst")


@query("edge_successors")
def _(spark, sf_dir):
    return graph.successors(_graph(spark, sf_dir, "line")[1], SUCCESSORS_OF)


@query("edge_has_edge")
def _(spark, sf_dir):
    edges = _graph(spark, sf_dir, "line")[1]
    return graph.has_edge(edges, SUCCESSORS_OF, HUB)


@per_profile("orphan_files_{}")
def _(spark, sf_dir, profile):
    return graph.orphan_files(*_graph(spark, sf_dir, profile), profile)


@per_profile("include_cycles_{}")
def _(spark, sf_dir, profile):
    cycles = graph.include_cycles(_graph(spark, sf_dir, profile)[1])
    return cycles.select("length", F.array_join("cycle", "|").alias("cycle"))


@per_profile("graph_stats_{}")
def _(spark, sf_dir, profile):
    return graph.graph_stats(*_graph(spark, sf_dir, profile))


@per_profile("in_degree_{}")
def _(spark, sf_dir, profile):
    return graph.in_degree(*_graph(spark, sf_dir, profile))


@per_profile("top_hubs_{}")
def _(spark, sf_dir, profile):
    return graph.top_hubs(*_graph(spark, sf_dir, profile))


# ------------------------------------------- counts, orders, limits, sets


@query("count_by_severity_line")
def _(spark, sf_dir):
    """Content findings only; file-name findings are not counted here."""
    return summary.count_by_severity(
        scan.scan_content(source_files(spark, sf_dir), "line", "HIGH"), ("credential", "security")
    )


@query("count_by_severity_span")
def _(spark, sf_dir):
    return summary.count_by_severity(all_findings(spark, sf_dir, "span", "INFO"))


@query("count_by_scanner")
def _(spark, sf_dir):
    return summary.count_by_scanner(all_findings(spark, sf_dir, "block", "INFO"))


@per_profile("file_stats_{}")
def _(spark, sf_dir, profile):
    return summary.file_stats(listing_of(spark, sf_dir), profile)


@query("scanner_finding_counts")
def _(spark, sf_dir):
    return summary.scanner_finding_counts(all_findings(spark, sf_dir, "span", "MEDIUM"), "MEDIUM")


@per_profile("sort_findings_{}", ("line", "block"))
def _(spark, sf_dir, profile):
    """All findings with their place in the order of the profile."""
    return summary.numbered(all_findings(spark, sf_dir, profile), summary.sort_keys(profile))


@query("limit_with_remainder_orphans")
def _(spark, sf_dir):
    orphans = materialize(graph.orphan_files(*_graph(spark, sf_dir, "line"), "line"))
    ranked = summary.first_ranked(orphans, ["node"], 20)
    more = F.greatest(F.col("total") - 20, F.lit(0)).cast("long")
    return ranked.select("rank", "node", "total", more.alias("more"))


@query("limit_with_remainder_cycles")
def _(spark, sf_dir):
    cycles = materialize(graph.include_cycles(_graph(spark, sf_dir, "span")[1]))
    shown = cycles.select("length", F.array_join("cycle", "|").alias("cycle"))
    return summary.first_ranked(shown, ["length", "cycle"], 10)


@query("union_findings")
def _(spark, sf_dir):
    return all_findings(spark, sf_dir, "block")


@query("dedup")
def _(spark, sf_dir):
    """Distinct (file, rule): a rule counts once per file however often it hits."""
    findings = scan.scan_security(source_files(spark, sf_dir), "span")
    return summary.deduplicate(findings, "file", "rule")


# ------------------------------------------------------------ incremental


@query("changed_files")
def _(spark, sf_dir):
    return incremental.changed_files(source_files(spark, sf_dir), _snapshot(spark, sf_dir)).select("path", "content")


@query("changed_paths")
def _(spark, sf_dir):
    return incremental.changed_paths(source_files(spark, sf_dir), _snapshot(spark, sf_dir))


@query("changed_tree_files")
def _(spark, sf_dir):
    """Changed project files of a tree on disk, each with the digest of what was read."""
    before = _snapshot(spark, sf_dir)
    changed = incremental.changed_tree(spark, _exported(spark, sf_dir), before, "line")
    return changed.select("path", F.sha2("content", 256).alias("digest"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.save_snapshot(incremental.fingerprints(source_files(spark, sf_dir, SNAPSHOT_DATE)), 8)


@query("new_findings")
def _(spark, sf_dir):
    now = scan.scan_content(source_files(spark, sf_dir), "line")
    before = scan.scan_content(source_files(spark, sf_dir, SNAPSHOT_DATE), "line")
    return incremental.new_findings(now, before)


@query("gate")
def _(spark, sf_dir):
    """Would the change since the snapshot be blocked?"""
    changed = incremental.changed_files(source_files(spark, sf_dir), _snapshot(spark, sf_dir))
    leaks = scan.scan_leaks(
        scan.decoded(changed.filter(scan.is_leak_candidate(F.col("path"))), "span")
    )
    return incremental.gate(leaks, "HIGH")


# ---------------------------------------------------------------- reports

ROOT = "/srv/project"


def _text(rows: DataFrame) -> DataFrame:
    return rows.select("section", "text")


def _graph_tables(spark, sf_dir, profile):
    nodes, edges = _graph(spark, sf_dir, profile)
    edges = materialize(edges)
    return (
        graph.graph_stats(nodes, edges),
        materialize(graph.top_hubs(nodes, edges)),
        materialize(graph.orphan_files(nodes, edges, profile)),
        materialize(graph.include_cycles(edges)),
    )


@per_profile("report_summary_{}", ("line", "span"))
def _(spark, sf_dir, profile):
    findings = all_findings(spark, sf_dir, profile, "HIGH")
    counted = ("credential", "security") if profile == "line" else None
    return _text(rp.summary_rows(summary.count_by_severity(findings, counted), profile))


@query("report_summary_block")
def _(spark, sf_dir):
    findings = all_findings(spark, sf_dir, "block", "HIGH")
    return _text(rp.scanner_summary_rows(findings, rp.BLOCK_ORDER, True))


@per_profile("report_file_stats_{}", ("line", "span"))
def _(spark, sf_dir, profile):
    return _text(rp.file_stats_rows(summary.file_stats(listing_of(spark, sf_dir), profile), profile))


@per_profile("report_findings_{}")
def _(spark, sf_dir, profile):
    findings = materialize(all_findings(spark, sf_dir, profile, "HIGH"))
    return _text(rp.finding_rows(findings, profile))


@per_profile("report_graph_{}")
def _(spark, sf_dir, profile):
    return _text(rp.graph_rows(*_graph_tables(spark, sf_dir, profile), profile))


@query("report_dead_files")
def _(spark, sf_dir):
    return _text(rp.dead_file_rows(deadfiles.scan_names(listing_of(spark, sf_dir), "line")))


@query("report_empty")
def _(spark, sf_dir):
    """No provider leaks in project files of the block profile: empty states."""
    found = scan.apply_rules(source_files(spark, sf_dir), _NO_SUCH, "line")
    parts = [rp.finding_rows(found, "line"), rp.finding_rows(found, "span"), rp.dead_file_rows(found)]
    return _text(rp.joined(*parts, rp.no_issue_rows(found)))


# A rule that no line of the tree meets.
_NO_SUCH = [rules.RuleSpec("goto_call", "HIGH", (r"\bgoto_label\s*\(",), keywords=("goto_label",))]


@query("write_markdown")
def _(spark, sf_dir):
    """The whole span report, written as text and read back."""
    result = plan.analyze(source_files(spark, sf_dir), "span", "all", "HIGH").whole()
    output = run_dir(spark, "markdown")
    sinks.write_markdown(plan.markdown(result, ROOT), output)
    return spark.read.text(output).select(F.col("value").alias("text"))


@query("write_json")
def _(spark, sf_dir):
    """All findings of the line profile, written as JSON and read back."""
    result = plan.analyze(source_files(spark, sf_dir), "line", "all", "HIGH").whole()
    output = run_dir(spark, "json")
    sinks.write_json(result.tables(), output)
    ddl = "file string, line int, rule string, severity string, match string, scanner string"
    return spark.read.schema(ddl).json(f"{output}/findings")


@query("write_json_tables")
def _(spark, sf_dir):
    """Sizes of the other tables of the same JSON output."""
    result = plan.analyze(source_files(spark, sf_dir), "span", "deps").whole()
    output = run_dir(spark, "json")
    sinks.write_json(result.tables(), output)
    stats = spark.read.schema("nodes long, edges long").json(f"{output}/graph_stats")
    total = spark.read.schema("total_files long").json(f"{output}/stats")
    orphans = spark.read.schema("node string").json(f"{output}/orphans")
    return stats.select(
        "nodes",
        "edges",
        total.select("total_files").scalar().alias("total_files"),
        orphans.agg(F.count("*")).scalar().alias("orphans"),
    )


_RECORD = "file string, line int, rule string, severity string, match string"
GENERATED = "2000-01-01T00:00:00"


@query("write_json_document")
def _(spark, sf_dir):
    """The whole run of the line profile as one JSON document, read back: its findings, root, time and sizes."""
    result = plan.analyze(source_files(spark, sf_dir), "line", "all", "HIGH").whole()
    output = run_dir(spark, "document")
    plan.write_document(result, ROOT, output, GENERATED)
    layout, values = jsondoc.read_document(spark, output)
    graph_part = layout["dependency_results"]
    cycles = values.filter("key = 'cycles'").count()
    findings = values.filter("key in ('credential_findings', 'security_findings', 'dead_findings')")
    return findings.select(
        F.lit(layout["generated_at"]).alias("generated_at"),
        F.lit(layout["root"]).alias("root"),
        F.lit(layout["stats"]["total_files"]).cast("long").alias("total_files"),
        F.lit(graph_part["node_count"]).cast("long").alias("nodes"),
        F.lit(graph_part["edge_count"]).cast("long").alias("edges"),
        F.lit(cycles).cast("long").alias("cycles"),
        F.inline(F.array(F.from_json("text", _RECORD))),
    )


# ---------------------------------------------------------------- sources


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """The tree as real files, written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EXPORTS:
        folder = run_dir(spark, "tree")
        tree.write_tree(source_files(spark, sf_dir), folder)
        _EXPORTS[key] = folder
    return _EXPORTS[key]


_EXPORTS: dict[tuple[str, str], str] = {}


@per_profile("scan_source_files_{}")
def _(spark, sf_dir, profile):
    """Project files listed and read from a file tree, with a digest of the bytes."""
    root = _exported(spark, sf_dir)
    files = tree.read_contents(scan.custom_files(tree.list_tree(spark, root), profile), root)
    return files.select("path", F.sha2("content", 256).alias("digest"))


@query("scan_all_nonvendor_files")
def _(spark, sf_dir):
    listing = tree.list_tree(spark, _exported(spark, sf_dir), prune_vendor=True)
    return listing.filter(px.is_custom(F.col("path"), "span"))


@query("scan_unpruned_files")
def _(spark, sf_dir):
    listing = tree.list_tree(spark, _exported(spark, sf_dir))
    return listing.filter(px.is_php(F.col("path"), "line"))


@query("scan_tree_findings")
def _(spark, sf_dir):
    """From files on disk to findings: list, filter, read, scan."""
    listing, files = tree.read_project(spark, _exported(spark, sf_dir), "line")
    return summary.union_findings(
        scan.scan_content(files, "line"), deadfiles.scan_names(listing, "line")
    )


def _broken_bytes(content):
    """Bytes of which every third file (by length) holds one that is no UTF-8."""
    marked = F.when(F.length(content) % 3 == 0, F.concat(content, F.lit("caf\u00ff;"))).otherwise(content)
    # The text is ASCII but for the mark, so its two bytes cannot be mistaken.
    return F.unhex(F.replace(F.hex(F.encode(marked, "UTF-8")), F.lit("C3BF"), F.lit("FF")))


@per_profile("decode_text_{}")
def _(spark, sf_dir, profile):
    """Bytes of which every third file (by length) holds one that is no UTF-8."""
    files = source_files(spark, sf_dir)
    return scan.decoded(files.select("path", _broken_bytes(F.col("content")).alias("content")), profile)


# -------------------------------------------------------------- streaming


def _stream_to_table(spark: SparkSession, findings: DataFrame) -> DataFrame:
    output, state = run_dir(spark, "stream"), run_dir(spark, "stream-state")
    started = streaming.append_findings(findings, output, state, once=True)
    started.awaitTermination()
    return spark.read.schema(findings.schema).parquet(output)


@query("stream_scan")
def _(spark, sf_dir):
    """Orders arrive as lines and pass the line rules."""
    orders = streaming.arriving_rows(spark, f"{sf_dir}/orders.parquet")
    lines = orders.select(
        F.expr(corpus.path_sql("o_custkey")).alias("path"),
        F.col("o_orderkey").alias("line_no"),
        F.expr(corpus.template_sql("o_orderkey")).alias("line"),
    )
    return _stream_to_table(spark, streaming.scan_line_stream(lines, rules.LINE_SECURITY))


@query("stream_scan_documents")
def _(spark, sf_dir):
    """Documents arrive and are checked for secrets over their whole text."""
    docs = streaming.arriving_rows(spark, f"{sf_dir}/documents.parquet")
    texts = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    return _stream_to_table(spark, scan.scan_leaks(texts))


@query("stream_scan_files")
def _(spark, sf_dir):
    """Files of a tree on disk arrive, hidden names too, and pass the content rules."""
    files = streaming.arriving_files(spark, _exported(spark, sf_dir), settle=0)
    return _stream_to_table(spark, streaming.scan_file_stream(files, "line"))
