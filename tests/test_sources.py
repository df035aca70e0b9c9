"""Trees on several file systems, arriving files, one read of contents, one JSON document, exchange-free snapshots."""

import json
import os
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from riskloom import analyze, run_job
from riskloom.operators import incremental, onepass, scan
from riskloom.operators.rules import CREDENTIALS, security_rules
from riskloom.plans.analyze import write_document
from riskloom.sources import jsondoc, tree
from riskloom.streaming import scan as streaming

TREE = {
    "index.php": b"<?php\r\ninclude 'lib/a.php';\r\neval($x);\r\n",
    "lib/a.php": b"<?php include 'b.php'; $db->query('x' . $_GET['q']);\n",
    "lib/b.php": b"<?php require 'a.php'; $api_key = 'k1';\n",
    "_draft.php": b"<?php // \xff\n",
    ".hidden.php": b"<?php eval(1);\n",
    ".dir/_in/x.php": b"<?php system('ls');\n",
    "vendor/v.php": b"<?php eval(1);\n",
}


def build(folder, content=TREE):
    for path, data in content.items():
        target = os.path.join(folder, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(data)
    return str(folder)


def vault_at(base):
    """A file system of its own, whose roots look like ``vault://name/path``."""
    return lambda uri: (fs.SubTreeFileSystem(base, fs.LocalFileSystem()), uri.partition("://")[2])


@pytest.fixture(params=["path", "file", "vault"])
def root(request, tmp_path):
    build(tmp_path / "project")
    if request.param == "path":
        return str(tmp_path / "project")
    if request.param == "file":
        return f"file://{tmp_path}/project"
    tree.register_file_system("vault", vault_at(str(tmp_path)))
    return "vault://project"


def test_any_file_system(spark, root):
    assert {r.path: r.length for r in tree.list_tree(spark, root).collect()} == {p: len(c) for p, c in TREE.items()}
    assert {r.path for r in tree.list_tree(spark, root, prune_vendor=True).collect()} == set(TREE) - {"vendor/v.php"}
    listing, files = tree.read_project(spark, root, "line")
    custom = {p: c for p, c in TREE.items() if not p.startswith("vendor/")}
    assert {r.path: bytes(r.content) for r in files.collect()} == custom
    copy = root + "-copy"
    tree.write_tree(files, copy)
    again = tree.read_contents(tree.list_tree(spark, copy), copy)
    assert {r.path: bytes(r.content) for r in again.collect()} == custom
    digests = {r.path: r.digest for r in tree.digest_contents(listing, root).collect()}
    known = {r.path: r.digest for r in incremental.fingerprints(files).collect()}
    assert {p: digests[p] for p in custom} == known


def test_lazy_listing(spark, root):
    spark.dataSource.register(tree.SourceTree)
    reader = spark.read.format("srctree").option("place", tree.Place.of(root).pack())
    for units in (2, 64):
        found = reader.option("units", str(units)).load()
        assert {r.path for r in found.collect()} == set(TREE)
        assert found.rdd.getNumPartitions() <= units


def test_a_whole_run_on_another_file_system(spark, tmp_path):
    build(tmp_path / "project")
    tree.register_file_system("vault", vault_at(str(tmp_path)))
    out = str(tmp_path / "report")
    result = run_job(spark, "vault://project", "line", "all", "HIGH", out, "both")
    assert {(r.file, r.rule) for r in result.findings.collect()} == {
        ("index.php", "eval_usage"), ("lib/a.php", "sql_injection"), ("lib/b.php", "hardcoded_assignment"),
        (".hidden.php", "eval_usage"), (".dir/_in/x.php", "shell_exec"), ("_draft.php", "dead_file"),
    }
    assert result.counts == {"files": 6, "bytes": sum(len(c) for p, c in TREE.items() if p != "vendor/v.php"), "skipped": 0}
    whole = json.load(open(out + ".document.json", encoding="utf-8"))
    assert whole["dependency_results"]["cycles"] == [["lib/a.php", "lib/b.php"]]


def test_many_folders_in_few_tasks(spark, tmp_path):
    names = {f"d{k:04}/s{k % 3}/f.php": b"x" for k in range(3000)}
    names |= {"/".join(f"n{j}" for j in range(k)) + "/deep.php": b"y" for k in range(1, 60)}
    root = build(tmp_path / "wide", names)
    started = time.time()
    found = tree.list_tree(spark, root, units=16)
    assert {r.path for r in found.collect()} == set(names)
    assert time.time() - started < 60
    rounds = Counter(path.split("round=")[1].split("/")[0] for path in tree.walk_tree(spark, root, units=16).inputFiles())
    assert max(rounds.values()) <= 16 and len(rounds) < 12


def test_a_path_outside_of_the_tree_is_an_error(spark, tmp_path):
    for path in ("../x.php", "/x.php", "a/../../x.php"):
        with pytest.raises(Exception, match="outside of the tree"):
            tree.write_tree(spark.createDataFrame([(path, b"x")], tree.CONTENT_DDL), str(tmp_path / "t"))
    assert not os.path.exists(tmp_path / "x.php")


def test_links_to_folders_are_not_followed(spark, tmp_path):
    root = build(tmp_path / "p", {"a/x.php": b"1"})
    os.symlink(root, os.path.join(root, "a", "loop"))
    assert [r.path for r in tree.list_tree(spark, root).collect()] == ["a/x.php"]


# ------------------------------------------------------------ arriving files


def test_files_arrive_once(spark, root, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        found = streaming.scan_file_stream(streaming.arriving_files(spark, root, settle=0), "line")
        streaming.append_findings(found, out, state, once=True).awaitTermination()
        return Counter((r.file, r.rule) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == Counter({
        ("index.php", "eval_usage"): 1, ("lib/a.php", "sql_injection"): 1, ("lib/b.php", "hardcoded_assignment"): 1,
        (".hidden.php", "eval_usage"): 1, (".dir/_in/x.php", "shell_exec"): 1,
    })
    build(str(tmp_path / "project"), {".late.php": b"<?php eval(2);", "lib/_new/y.php": b"<?php exec('x');"})
    second = run()
    assert second - first == Counter({(".late.php", "eval_usage"): 1, ("lib/_new/y.php", "shell_exec"): 1})
    assert run() == second


def test_young_files_wait(spark, tmp_path):
    reader = streaming_reader(build(tmp_path / "p"), settle=1000)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [row for part in parts for row in reader.read(part)] == []
    end = {"until": time.time_ns()}
    batches = [b for part in reader.partitions(reader.initialOffset(), end) for b in reader.read(part)]
    assert sorted(p for b in batches for p in b.column("path").to_pylist()) == sorted(TREE)
    assert reader.partitions(end, end) == []


def streaming_reader(root, settle):
    from riskloom.streaming.files import ArrivalReader

    return ArrivalReader({"path": root, "settle": str(settle)})


# ------------------------------------------------------------ one read


@pytest.fixture
def counted(spark, files):
    """A content table, and how many of its rows have been read."""
    rows = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return files(TREE).repartition(3).mapInArrow(tally, "path string, content binary"), rows


@pytest.mark.parametrize("profile", ["line", "span", "block"])
def test_all_outputs_come_of_one_read(spark, files, listing, counted, profile):
    contents, rows = counted
    result = analyze(contents, profile, "all", "INFO", listing(*TREE))
    assert rows.value == len(TREE)
    plain = files(TREE)
    apart = scan.scan_content(plain, profile, "INFO")
    together = result.findings.filter("scanner <> 'dead'")
    assert Counter(together.collect()) == Counter(apart.collect())
    assert {(c.length, *c.cycle) for c in result.cycles.collect()} == {(2, "lib/a.php", "lib/b.php")}
    skipped = {(r.path, r.reason) for r in result.skipped.collect()}
    assert skipped == ({("_draft.php", scan.NOT_UTF8)} if profile == "block" else set())
    assert result.counts["files"] == 6 and result.counts["skipped"] == len(skipped)


def test_file_names_need_no_contents(spark, listing, counted):
    contents, rows = counted
    result = analyze(contents, "line", "dead", "INFO", listing(*TREE))
    assert [r.file for r in result.findings.collect()] == ["_draft.php"] and rows.value == 0
    assert result.skipped is None and result.counts == {}


def test_one_pass_plan_has_one_scan_and_no_exchange(spark, files, tmp_path):
    files(TREE).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for profile in ("line", "span", "block"):
        rows = onepass.tagged_rows(stored, (*CREDENTIALS, *security_rules(profile)), profile)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan


def test_skipped_files(spark):
    rows = [("a.php", b"ok"), ("b.php", None), ("c.php", b"\xff"), ("vendor/d.php", None), ("e.txt", None)]
    table = spark.createDataFrame(rows, "path string, content binary")
    for profile, want in (("line", {("b.php", scan.UNREADABLE)}), ("block", {("b.php", scan.UNREADABLE), ("c.php", scan.NOT_UTF8)})):
        assert {tuple(r) for r in scan.skipped_files(table, profile).collect()} == want


def test_a_failed_cycle_search_leaves_the_rest(files, monkeypatch, tmp_path):
    from riskloom.operators import graph
    from riskloom.plans.analyze import markdown

    def fail(edges):
        raise RuntimeError("too many cycles")

    monkeypatch.setattr(graph, "include_cycles", fail)
    result = analyze(files(TREE), "line", "all", "INFO")
    assert result.cycles is None and "too many" in result.failures["cycles"]
    text = [r.text for r in markdown(result, "/r").collect()]
    assert "| `lib/a.php` | 2 |" in text and any("eval" in t for t in text)
    write_document(result, "/r", str(tmp_path / "d.json"))
    whole = json.load(open(tmp_path / "d.json", encoding="utf-8"))
    assert whole["failures"]["cycles"] == "too many cycles" and whole["dependency_results"]["cycles"] == []


# ------------------------------------------------------------ one document


@pytest.mark.parametrize("profile", ["line", "span", "block"])
def test_document(files, tmp_path, profile):
    result = analyze(files({**TREE, "q\"uote\\é.php": b"<?php eval(1);"}), profile, "all", "INFO")
    target = str(tmp_path / "out" / "run.json")
    os.makedirs(tmp_path / "out")
    for _ in range(2):  # a second run replaces the document
        write_document(result, "/srv", target, "2001-02-03T04:05:06")
    assert os.listdir(tmp_path / "out") == ["run.json"]
    whole = json.load(open(target, encoding="utf-8"))
    found = result.findings.collect()
    meta = whole if profile == "line" else whole["meta"]
    assert meta["root"] == "/srv" and meta["generated_at"] == "2001-02-03T04:05:06"
    if profile == "line":
        parts = {s: whole[f"{s}_findings"] for s in ("credential", "security", "dead")}
        assert whole["dependency_results"]["node_count"] == 7 and whole["stats"]["total_files"] == 8
    elif profile == "span":
        parts = {s.replace("deadfile", "dead"): v for s, v in whole["findings"].items()}
    else:
        parts = {s.removesuffix("_scanner"): v for s, v in whole.items() if s.endswith("_scanner")}
        assert meta["skipped_files"] == [{"path": "_draft.php", "reason": scan.NOT_UTF8}]
    for scanner, rows in parts.items():
        want = [r.asDict() for r in found if r.scanner == scanner]
        assert Counter(tuple(sorted(r.items())) for r in rows) == Counter(
            tuple(sorted((k, v) for k, v in r.items() if k != "scanner")) for r in want
        )
    weights = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
    order = [((0 if profile == "block" else -weights[r["severity"]]), r["file"], r["line"]) for r in parts["security"]]
    assert order == sorted(order) and len(order) > 2


def test_document_after_a_failed_attempt(tmp_path):
    target = str(tmp_path / "run.json")
    layout = json.dumps({"a": jsondoc.many(0), "b": jsondoc.one(1), "c": jsondoc.one(2), "d": jsondoc.many(3)})
    writer = jsondoc.DocumentWriter({"path": target, "parts": ".parts", "layout": layout})
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"slot": s, "text": t} for s, t in rows])

    def dies():
        yield batch((0, "1"), (0, '"lost"'))
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(dies())
    first = writer.write(iter([batch((0, "1")), batch((0, "[2]"), (1, '{"x": "é"}'))]))
    writer.write(iter([batch((0, '"a repeated attempt that is not committed"'))]))
    second = writer.write(iter([batch((3, '"z"'))]))
    second.partition = 1
    writer.commit([second, first, None])
    assert json.load(open(target, encoding="utf-8")) == {"a": [1, [2]], "b": {"x": "é"}, "c": None, "d": ["z"]}
    assert os.listdir(tmp_path) == ["run.json"]


def test_many_tasks_read_one_document(spark, tmp_path):
    target = str(tmp_path / "run.json")
    values = [(k % 3, json.dumps({"k": k, "text": "],é\n" * 50}, ensure_ascii=False)) for k in range(3000)]
    rows = spark.createDataFrame([*values, (4, '["a"]'), (5, '{"n": 1}')], "slot int, text string").repartition(5).sortWithinPartitions("slot")
    layout = {"a": jsondoc.many(0), "in": {"b": jsondoc.many(1), "none": jsondoc.many(3)}, "c": jsondoc.many(2), "one": jsondoc.one(5), "d": jsondoc.many(4)}
    jsondoc.write_document(rows, layout, target)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        frame, read = jsondoc.read_document(spark, target)
        got = [tuple(r) for r in read.collect()]
        assert len(read.inputFiles()) > 10  # written by as many tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert frame == {"a": [], "in": {"b": [], "none": []}, "c": [], "one": {"n": 1}, "d": []}
    assert Counter(got) == Counter([("abc"[slot], text) for slot, text in values] + [("d", '["a"]')])
    assert len(json.load(open(target, encoding="utf-8"))["in"]["b"]) == 1000


# ------------------------------------------------------------ snapshots


def exchanged(df):
    """Columns that go through exchanges."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = [b for b in plan.split("\n\n") if ") Exchange" in b]
    return "\n".join(line for b in blocks for line in b.splitlines() if line.startswith("Input"))


def test_no_exchange_carries_contents(spark, files):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = files({f"{k}.php": f"{k}" for k in range(200)})
        now = files({f"{k}.php": f"{k if k % 50 else -k}" for k in range(-1, 200)})
        known = incremental.save_snapshot(incremental.fingerprints(old), 4)
        paths = incremental.changed_paths(now, known)
        plan = paths._jdf.queryExecution().executedPlan().toString()
        # The snapshot lies in buckets: only what it is compared with is exchanged.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert "content" not in exchanged(paths)
        want = {"-1.php", "50.php", "100.php", "150.php"}
        assert {r.path for r in paths.collect()} == want
        for most in (100, 0):
            changed = incremental.changed_files(now, known, 4, most)
            assert "content" not in exchanged(changed), exchanged(changed)
            assert {r.path for r in changed.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changed_tree(spark, tmp_path):
    root = build(tmp_path / "p")
    _, files = tree.read_project(spark, root, "line")
    known = incremental.save_snapshot(incremental.fingerprints(files), 4)
    assert incremental.changed_tree(spark, root, known, "line").count() == 0
    build(root, {"lib/a.php": b"<?php // new", "n/_m.php": b"<?php", "vendor/v.php": b"changed"})
    changed = {r.path: bytes(r.content) for r in incremental.changed_tree(spark, root, known, "line").collect()}
    assert changed == {"lib/a.php": b"<?php // new", "n/_m.php": b"<?php"}


def test_new_findings_by_digest(spark):
    ddl = "scanner string, file string, line int, rule string, severity string, match string"
    long = "x" * 100_000
    old = spark.createDataFrame([("s", "a", 1, "r", "LOW", long)], ddl)
    now = spark.createDataFrame([("s", "a", 9, "r", "LOW", long), ("s", "a", 1, "r", "LOW", long + "y")], ddl)
    fresh = incremental.new_findings(now, old)
    assert fresh.columns == now.columns and [r.match[-1] for r in fresh.collect()] == ["y"]
    assert fresh.select(F.length("match")).first()[0] == 100_001
