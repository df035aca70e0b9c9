"""Trees on disk, whole runs, reports, streams, incremental scans."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom import analyze, run_job
from riskloom.model import FINDING_DDL
from riskloom.operators import incremental, scan, summary
from riskloom.plans import report as rp
from riskloom.plans.analyze import markdown
from riskloom.sources import tree
from riskloom.streaming import scan as streaming

TREE = {
    "index.php": b"<?php\r\ninclude 'lib/a.php';\r\neval($x);\r\n",
    "lib/a.php": b"<?php include 'b.php'; $db->query('x' . $_GET['q']);\n",
    "lib/b.php": b"<?php require 'a.php'; $api_key = 'k1';\n",
    "_draft.php": b"<?php // \xff\n",
    ".hidden.php": b"<?php eval(1);\n",
    "up/Shout.PHP": b"<?php system('ls');\n",
    "vendor/v.php": b"<?php eval(1);\n",
    "app/vendor/w.php": b"<?php eval(1);\n",
    "readme-old.txt": b"eval(1)",
}


@pytest.fixture
def root(tmp_path):
    for path, content in TREE.items():
        target = tmp_path / "project" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(tmp_path / "project")


@pytest.mark.parametrize("units", [1, 3, 64])
def test_listing_sees_hidden_names(spark, root, units):
    got = {r.path: r.length for r in tree.list_tree(spark, root, units=units).collect()}
    assert got == {p: len(c) for p, c in TREE.items()}


def test_pruned_listing(spark, root):
    got = {r.path for r in tree.list_tree(spark, root, prune_vendor=True).collect()}
    assert got == set(TREE) - {"vendor/v.php"}


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="not a directory"):
        tree.list_tree(spark, str(tmp_path / "none")).collect()


def test_read_and_write_round_trip(spark, root, tmp_path):
    listing, files = tree.read_project(spark, root, "line")
    got = {r.path: bytes(r.content) for r in files.collect()}
    assert set(got) == {p for p in TREE if p.lower().endswith(".php")} - {"vendor/v.php"}
    copy = str(tmp_path / "copy")
    tree.write_tree(files, copy)
    again = tree.read_contents(tree.list_tree(spark, copy), copy)
    assert {r.path: bytes(r.content) for r in again.collect()} == got
    assert listing.count() == len(TREE)


def test_unreadable_file_is_skipped(spark, root):
    listing = tree.list_tree(spark, root)
    gone = spark.createDataFrame([("gone.php", 3)], tree.LISTING_DDL)
    files = tree.read_contents(listing.filter("path = 'index.php'").union(gone), root)
    assert {r.path: r.content is None for r in files.collect()} == {"index.php": False, "gone.php": True}
    assert {r.file for r in scan.scan_security(files, "line").collect()} == {"index.php"}


def test_binary_reader_misses_hidden_names(spark, root):
    got = {r.path for r in tree.read_binary_files(spark, root).collect()}
    assert "lib/a.php" in got and "_draft.php" not in got


def test_line_run(spark, root, tmp_path):
    out = str(tmp_path / "report")
    result = run_job(spark, root, "line", "all", "HIGH", out, "both")
    found = {(r.scanner, r.file, r.rule) for r in result.findings.collect()}
    assert found == {
        ("security", "index.php", "eval_usage"),
        ("security", "lib/a.php", "sql_injection"),
        ("credential", "lib/b.php", "hardcoded_assignment"),
        ("security", ".hidden.php", "eval_usage"),
        ("security", "up/Shout.PHP", "shell_exec"),
        ("security", "app/vendor/w.php", "eval_usage"),
        ("dead", "_draft.php", "dead_file"),
    }
    assert tuple(result.stats.first()) == (7, 1, 8)
    text = read_text(out + ".md")
    assert text.startswith("# Source risk report: lines\n\n**Generated:** ")
    assert "| 🔴 CRITICAL | 2 |" in text and "| ⚪ INFO | 0 |" in text
    assert "### Circular Dependencies (1 detected)\n\n1. `lib/a.php` → `lib/b.php`" in text
    assert "| `_draft.php` | special prefix in filename: _draft.php |" in text
    assert "| `lib/a.php` | 2 |" in text
    rows = [json.loads(line) for f in glob.glob(out + ".json/hubs/*.json") for line in open(f)]
    assert {"node": "lib/a.php", "in_degree": 2} in rows
    assert os.path.isdir(out + ".json/findings/scanner=security")


def read_text(folder):
    parts = sorted(glob.glob(folder + "/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_span_and_block_runs(spark, root, tmp_path):
    out = str(tmp_path / "span")
    run_job(spark, root, "span", "all", "LOW", out)
    text = read_text(out + ".md")
    assert "- Custom PHP files: `7`\n- Vendor PHP files (excluded): `1`" in text
    assert "- `LOW` [`readme-old.txt:1`](readme-old.txt#L1) **dead_or_backup_file** (deadfile): `backup_or_temp;suspicious_suffix`" in text
    assert text.index("`CRITICAL` [") < text.index("`HIGH` [") < text.index("`LOW` [")
    out = str(tmp_path / "block")
    run_job(spark, root, "block", "all", "INFO", out)
    text = read_text(out + ".md")
    assert "| Dependency Analysis | 5 |" in text and "## Security Scanner Scanner" in text
    assert "### `sql_injection`" in text and "up/Shout.PHP" not in text


def test_empty_reports(spark, files):
    tree_ = files({"a.php": "<?php\n"})
    line = [r.text for r in markdown(analyze(tree_, "line"), "/r").collect()]
    assert "_No credential findings._" in line and "_No dead/backup files found._" in line
    span = [r.text for r in markdown(analyze(tree_, "span", "security"), "/r").collect()]
    assert "_No findings._" in span
    block = [r.text for r in markdown(analyze(tree_, "block", "security"), "/r").collect()]
    assert block[-1] == rp.NO_ISSUES


@pytest.mark.parametrize(("mode", "scanners"), [("security", {"security", "credential"}), ("dead", {"dead"}), ("deps", set())])
def test_modes(files, mode, scanners):
    tree_ = files({"_a.php": "<?php eval(1); $key = 'x';"})
    result = analyze(tree_, "line", mode, "INFO")
    assert {r.scanner for r in result.findings.collect()} == scanners
    assert (result.cycles is not None) == (mode == "deps")
    with pytest.raises(ValueError):
        analyze(tree_, "line", "credential")
    with pytest.raises(ValueError):
        analyze(tree_, "line", "all", "BAD")


def test_summaries(spark):
    rows = [
        ("security", "b.php", 2, "x", "HIGH", "m"),
        ("security", "a.php", 9, "x", "CRITICAL", "m"),
        ("dead", "a.php", 0, "d", "LOW", "m"),
        ("dead", "c.php", 0, "d", None, "m"),
    ]
    df = spark.createDataFrame(rows, FINDING_DDL)
    counts = {r.severity: r.findings for r in summary.count_by_severity(df).collect()}
    assert counts == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 1, "INFO": 1}
    by = {r.scanner: r.findings for r in summary.count_by_scanner(df).collect()}
    assert by == {"security": 2, "dead": 2, "total": 4}
    order = [r.file for r in summary.sort_findings(df, "line").collect()]
    assert order == ["a.php", "b.php", "a.php", "c.php"]
    shown = summary.finding_display(df.limit(1)).first().display
    assert shown == "[HIGH] b.php:2 (x): 'm'"
    top = summary.first_ranked(df, ["file", "line"], 2).collect()
    assert [(r.rank, r.total) for r in top] == [(1, 4), (2, 4)]


def test_places_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v")).repartition(7)
    placed = summary.numbered(rows, ["k"]).collect()
    assert sorted((r.place, r.k) for r in placed) == [(k + 1, k) for k in range(5000)]
    assert summary.numbered(rows.limit(0), ["k"]).count() == 0


def test_incremental(files):
    before = files({"a.php": "<?php eval(1);", "b.php": "<?php"})
    after = files({"a.php": "<?php\n\neval(1);\nsystem('x');", "b.php": "<?php", "c.php": "<?php eval(2);"})
    known = incremental.fingerprints(before)
    assert {r.path for r in incremental.changed_files(after, known).collect()} == {"a.php", "c.php"}
    status = {r.path: r.status for r in incremental.changed_paths(after, known).collect()}
    assert status == {"a.php": "modified", "c.php": "added"}
    old, new = scan.scan_security(before, "span"), scan.scan_security(after, "span")
    fresh = incremental.new_findings(new, old)
    assert {(r.file, r.rule) for r in fresh.collect()} == {("a.php", "shell_exec"), ("c.php", "eval_usage")}
    assert tuple(incremental.gate(fresh, "CRITICAL").first()) == (1, True)
    assert tuple(incremental.gate(fresh.filter("false")).first()) == (0, False)


def test_stream_equals_batch(spark, files, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = files({"a.php": "<?php eval(1);", "vendor/b.php": "<?php eval(1);"})
    second = files({"c.php": "<?php system('x');"})
    first.write.parquet(source)
    run = lambda: streaming.append_findings(
        streaming.scan_file_stream(streaming.arriving_rows(spark, source), "span"), out, state, once=True
    ).awaitTermination()
    run()
    second.write.mode("append").parquet(source)
    run()
    got = {(r.file, r.rule) for r in spark.read.parquet(out).collect()}
    assert got == {("a.php", "eval_usage"), ("c.php", "shell_exec")}


def test_file_stream(spark, root, tmp_path):
    found = streaming.scan_file_stream(streaming.arriving_files(spark, root), "span", "CRITICAL")
    streaming.append_findings(found, str(tmp_path / "o"), str(tmp_path / "s"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).select(F.col("rule")).collect()
    assert sorted(r.rule for r in got) == ["shell_exec", "sql_injection"]
