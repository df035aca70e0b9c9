"""Rules stay linear in long lines and equal their plain patterns; own rules over whole texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import rules, scan, taint

SG3, SG4 = r"\$_(?:GET|POST|REQUEST)", r"\$_(?:GET|POST|REQUEST|COOKIE)"
PLAIN = {
    "sql_injection": (rf"(?:->|\b)(?:query|execute)\s*\(.*{SG3}\s*\[", rf"(?:->|\b)(?:query|execute)\s*\([^)]*\.\s*{SG3}"),
    "xss_direct_echo": (rf"\becho\b.*{SG4}\s*\[",),
}
BITS = ["->query(", "execute (", "query", "(", ")", "$_GET", "$_POST [", "[", ".", " ", "echo", "echoes", "x", "$_COOKIE[", "intval", "é"]


def texts_of(spark, *texts):
    return spark.createDataFrame([(f"{k}.php", t) for k, t in enumerate(texts)], "path string, text string")


@pytest.mark.parametrize("rule", sorted(PLAIN))
def test_looking_once_equals_the_plain_patterns(spark, rule):
    pick = random.Random(8)
    lines = ["".join(pick.choices(BITS, k=pick.randint(1, 14))) for _ in range(4000)]
    spec = next(r for r in rules.LINE_SECURITY if r.name == rule)
    bare = rules.RuleSpec(rule, spec.severity, spec.patterns)
    frame = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = {r.k for r in frame.filter(bare.hits(F.col("line"))).collect()}
    want = {k for k, line in enumerate(lines) if any(re.search(p, line, re.I) for p in PLAIN[rule])}
    assert got == want and 200 < len(want) < 3800


@pytest.mark.parametrize("end", ["", " $_GET"])
@pytest.mark.parametrize("unit", ["->query($x) ", "->query($x . ", "echo $x "])
def test_five_megabytes_in_one_line(spark, unit, end):
    line = unit * (5_000_000 // len(unit)) + end
    texts = texts_of(spark, line)
    scan.scan_lines(texts.limit(0), rules.LINE_SECURITY).collect()
    started = time.time()
    found = scan.scan_lines(texts, rules.LINE_SECURITY).select("rule").collect()
    assert time.time() - started < 10
    assert [r.rule for r in found] == (["sql_injection"] if end and unit.endswith(". ") else [])


def test_many_calls_without_a_semicolon(spark):
    calls, size = 20_000, 1_000_000
    text = ("$db->query(" + "a" * (size // calls - 11)) * calls
    started = time.time()
    found = taint.query_calls_table(texts_of(spark, text)).select("line", F.length("snippet").alias("n"), F.sha2("snippet", 256).alias("h")).collect()
    assert time.time() - started < 10
    assert len(found) == calls and {r.line for r in found} == {1} and {r.n for r in found[:-20]} == {600}
    assert found[0].h == found[1].h


def test_many_calls_in_one_statement(spark):
    # Snippets that lie within each other: their sum would be some 10 GB.
    text = ("$db->query(" + "a" * 39) * 20_000 + "$_GET['x'];" + "$db->query(1);" * 1000
    started = time.time()
    rows = texts_of(spark, text).select(F.inline(taint.sql_injection(F.col("text")))).select(tx.shorten(F.col("match")).alias("m"))
    found = rows.collect()
    assert time.time() - started < 20
    assert len(found) == 20_000 and {len(r.m) for r in found[:-10]} == {160}


def test_shown_calls_equal_whole_snippets(spark):
    pick = random.Random(9)
    bits = ["$db->query(", "->execute (", ";", " ", "\n", "\t" * 30, "$_GET['a']", "$v", "$v = $_POST['b'];", "x" * 50, "$q->query($v", " " * 300, "é"]
    texts = ["".join(pick.choices(bits, k=pick.randint(1, 25))) for _ in range(600)]
    frame = texts_of(spark, *texts)
    show = lambda column, name: frame.select("path", F.inline(column(F.col("text")))).select("path", "line", tx.shorten(F.col(name)).alias("m"))
    whole = sorted(map(tuple, show(taint.tainted_calls, "snippet").collect()))
    assert sorted(map(tuple, show(taint.sql_injection, "match").collect())) == whole and len(whole) > 300


def by_hand(text, patterns, veto):
    found = []
    for m in re.finditer("|".join(f"(?:{p})" for p in patterns), text, re.I):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        lines = text[a : b if b >= 0 else len(text)].lower()
        if not any(token in lines for token in veto):
            found.append((text.count("\n", 0, m.start()) + 1, m.group(0)))
    return found


def test_own_rules_over_whole_texts(spark):
    patterns, veto = (r"\bopen\s*\([^)]*\)", r"\bopen\b", r"\bclose\s*;", r"b\s+c"), ("safe", "guard(")
    rule = rules.RuleSpec("own", "LOW", patterns, veto=veto, scanner="own")
    pick = random.Random(10)
    bits = ["open(", "open", ")", "close", ";", " ", "\n", "safe", "guard(", "b", "c", "\n\n", "é", "\u0001", "SAFE", "x"]
    texts = ["".join(pick.choices(bits, k=pick.randint(1, 30))) for _ in range(1500)]
    got = {}
    for r in scan.scan_texts(texts_of(spark, *texts), [rule], "block").collect():
        got.setdefault(int(r.file[:-4]), []).append((r.line, r.match))
    hits = 0
    for k, text in enumerate(texts):
        want = [(line, m.strip()) for line, m in by_hand(text, patterns, veto)]
        assert got.get(k, []) == want, (text, got.get(k), want)
        hits += len(want)
    assert hits > 200


def test_rules_that_cannot_run_on_whole_texts():
    with pytest.raises(ValueError, match="single lines"):
        rules.RuleSpec("a", "LOW", (rules.After("x", "y"),)).text_pattern  # noqa: B018
    with pytest.raises(ValueError, match="only one"):
        rules.RuleSpec("a", "LOW", (r"(['\"])x\1", "y")).text_pattern  # noqa: B018
    assert rules.RuleSpec("a", "LOW", (r"(['\"])x\1",)).text_pattern.endswith(r"\1")
