"""A part of a run that failed is named everywhere and is never taken for a result."""

import glob
import json

import pytest

from riskloom import run_job
from riskloom.operators import graph
from riskloom.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def failing(monkeypatch):
    def fail(edges):
        raise RuntimeError("too many cycles")

    monkeypatch.setattr(graph, "include_cycles", fail)


@pytest.mark.parametrize("name", ["write_json_document", "write_json", "write_json_tables", "write_markdown"])
def test_queries_fail_with_the_cycle_search(spark, failing, name):
    with pytest.raises(RuntimeError, match="cycles failed: too many cycles"):
        QUERIES[name](spark, SF)


@pytest.mark.parametrize("profile", ["line", "span", "block"])
def test_a_job_writes_what_it_has_and_fails(spark, failing, tmp_path, profile):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.php").write_text("<?php include 'b.php'; eval(1);")
    (tmp_path / "in" / "b.php").write_text("<?php include 'a.php';")
    out = str(tmp_path / "report")
    with pytest.raises(RuntimeError, match="cycles failed: too many cycles"):
        run_job(spark, str(tmp_path / "in"), profile, "all", "INFO", out, "both")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(out + ".md/part-*")))
    assert "- **Failed:** cycles: too many cycles" in text and "eval" in text
    rows = [json.loads(line) for f in glob.glob(out + ".json/failures/*.json") for line in open(f, encoding="utf-8")]
    assert rows == [{"name": "cycles", "reason": "too many cycles"}]
    whole = json.load(open(out + ".document.json", encoding="utf-8"))
    assert whole["failures"] == {"cycles": "too many cycles"}
