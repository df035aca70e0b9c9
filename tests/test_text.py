"""Text and path expressions against plain Python on generated inputs."""

import posixpath
import random
import re

from pyspark.sql import functions as F

from riskloom.functions import paths as px
from riskloom.functions import text as tx
from riskloom.operators import scan, taint

ALPHABET = ["a", "b", "eval", "(", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ",
            "é", "|", "'", '"', "\\", ";", "\u0001", "�", "𝄞"]


def samples(n, size, alphabet=ALPHABET, seed=7):
    rng = random.Random(seed)
    return ["", "\n", "a\n", "a\n\n"] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)
    ]


def evaluate(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", build(F.col("text")).alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.i)]


def universal(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def test_split_lines(spark):
    texts = samples(300, 30)
    got = evaluate(spark, texts, lambda t: tx.split_lines(tx.normalize_newlines(t)))
    assert got == [universal(t).splitlines() for t in texts]


def test_shorten_and_cell(spark):
    texts = samples(200, 300)

    def short(s):
        s = " ".join(s.split())
        return s if len(s) <= 160 else s[:159] + "…"

    def cell(s):
        clean = " ".join(s.splitlines()).strip()
        return clean.replace("|", "\\|")[:80] + ("…" if len(clean) > 80 else "")

    # The mark is a control character here, so leave it out of display texts.
    texts = [t.replace("\u0001", "") for t in texts]
    assert evaluate(spark, texts, tx.shorten) == [short(t) for t in texts]
    assert evaluate(spark, texts, tx.markdown_cell) == [cell(universal(t)) for t in texts]


def test_quoted(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\tend"]
    assert evaluate(spark, texts, tx.quoted) == [repr(t) for t in texts]


def test_match_positions(spark):
    texts = samples(300, 60, ["eval", "(", " ", "\n", "x", "_", "\u0001", ";"])
    pattern = re.compile(r"\beval\s*\(", re.I)
    got = evaluate(spark, texts, lambda t: scan.pattern_hits(t, r"(?iU)\beval\s*\("))
    want = [[(t.count("\n", 0, m.start()) + 1, m.group(0)) for m in pattern.finditer(t)] for t in texts]
    assert [[(h.line, h.match) for h in hits] for hits in got] == want


def test_taint_against_brute_force(spark):
    pieces = ["$id", "$x", " = ", "$_GET['a']", ";", "\n", "->query(", "->execute (", "intval(", ")", " . ", "y"]
    texts = samples(400, 40, pieces, seed=3) + ["->query(" + "z" * 700 + "$_GET['late']", "->query(" + "z" * 100]
    assign = re.compile(r"\$([A-Za-z_]\w*)\s*=\s*(.+?)\s*;", re.A)
    request = re.compile(r"\$_(GET|POST|REQUEST|COOKIE)\b", re.I)

    def brute(text):
        tainted = set()
        for line in text.splitlines():
            m = assign.search(line)
            if m and request.search(m.group(2)) and "intval(" not in m.group(2):
                tainted.add(m.group(1))
        hits = []
        for m in re.finditer(r"->\s*(query|execute)\s*\(", text, re.I):
            end = text.find(";", m.start())
            snippet = text[m.start() : end if end >= 0 else m.start() + 600]
            if request.search(snippet) or any("$" + v in snippet for v in tainted):
                hits.append((text.count("\n", 0, m.start()) + 1, snippet))
        return hits

    got = evaluate(spark, texts, taint.tainted_calls)
    assert [[(h.line, h.snippet) for h in hits] for hits in got] == [brute(t) for t in texts]


def test_block_match_equals_one_greedy_pattern(spark):
    pieces = ["query", "execute", "(", " ", "\n", "$_GET[", "$_POST", "x", "["]
    texts = samples(400, 25, pieces, seed=5)
    whole = re.compile(r"(?:query|execute)\s*\(.*\$_(?:GET|POST|REQUEST)\[", re.I | re.S)
    got = evaluate(spark, texts, scan._first_call_to_last_request)
    want = [
        [(t.count("\n", 0, m.start()) + 1, m.group(0)) for m in whole.finditer(t)] for t in texts
    ]
    assert [[(h.line, h.match) for h in hits] for hits in got] == want


def test_normalize_path(spark):
    rng = random.Random(1)
    paths = [
        "/".join(rng.choice(["a", "b", "..", ".", "", "c.php"]) for _ in range(rng.randrange(1, 8)))
        for _ in range(300)
    ]
    absolute = ["/" + p.lstrip("/") for p in paths]
    relative = [p.lstrip("/") for p in paths]
    assert evaluate(spark, absolute, px.normalize_path) == [posixpath.normpath(p) for p in absolute]
    want = [posixpath.normpath(p) if p else "" for p in relative]
    assert evaluate(spark, relative, px.normalize_path) == ["" if w == "." else w for w in want]


def test_path_parts(spark):
    paths = ["a.php", "x/a.php", "x/y/.env", "x/y/name.", "x/.hid.php"]
    assert evaluate(spark, paths, px.basename) == [posixpath.basename(p) for p in paths]
    assert evaluate(spark, paths, px.parent) == [posixpath.dirname(p) for p in paths]
    assert evaluate(spark, paths, px.lacks_suffix) == [False, False, True, True, False]
    assert evaluate(spark, ["x/y/a.php"], px.ancestors) == [["", "x", "x/y"]]
