import random
import time

import pytest

from riskloom.operators import cycles, graph, includes
from riskloom.operators.skew import join_unique


def edges_of(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_extraction_forms(files):
    from riskloom.operators.scan import decoded

    text = (
        "<?php include 'a.php'; require_once(\"b.php\");\n"
        "include __DIR__ . '/c.php'; require dirname(__FILE__) . '/d.php';\n"
        "include 'up/' . $f;\ninclude 'x' . 'y.php';\npreinclude 'z.php';\ninclude\n'next.php';\n"
    )
    tree = decoded(files({"m.php": text}), "line")

    def raws(profile):
        return sorted(r.raw for r in includes.extract_includes(tree, profile).collect())

    assert raws("line") == ["/c.php", "/d.php", "a.php", "b.php", "up/", "x"]
    assert raws("span") == ["a.php", "b.php", "x' . 'y.php"]
    assert raws("block") == ["a.php", "b.php", "next.php", "up/", "x", "z.php"]


def test_resolution_order(files, listing):
    tree = {
        "app/main.php": "<?php include 'lib.php'; include 'top.php'; include '/abs.php';"
        " include 'noext'; include '../x.php'; include '../../x.php'; include 'http://h/abs.php';"
        " include 'vend.php';",
        "app/lib.php": "", "lib.php": "", "top.php": "", "abs.php": "", "noext.php": "", "x.php": "",
        "vend.php": "",
    }
    # In the tree app/vend.php is a directory, so it wins over vend.php and gives no edge.
    everything = listing(*tree, "app/vend.php/readme.txt")
    line = edges_of(includes.include_edges(files(tree), "line", everything))
    assert [d for _, d in line] == ["abs.php", "app/lib.php", "top.php", "x.php"]
    span = edges_of(includes.include_edges(files(tree), "span", everything))
    assert [d for _, d in span] == ["abs.php", "app/lib.php", "noext.php", "top.php", "x.php"]
    block = edges_of(includes.include_edges(files(tree), "block", everything))
    assert [d for _, d in block] == ["app/lib.php", "x.php"]


def test_absolute_paths_below_a_known_root(files):
    tree = {"a.php": "<?php include '/srv/p/b.php';", "b.php": ""}
    assert edges_of(includes.include_edges(files(tree), "block", root="/srv/p")) == [("a.php", "b.php")]
    assert edges_of(includes.include_edges(files(tree), "block")) == []


def test_heavy_target_takes_the_split_path(files):
    tree = {f"d/f{i}.php": "<?php include '../hub.php'; include 'f0.php';" for i in range(30)}
    tree["hub.php"] = ""
    plain = edges_of(includes.include_edges(files(tree), "line"))
    split = edges_of(includes.include_edges(files(tree), "line", heavy_min_rows=5))
    assert plain == split and len(plain) == 60


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_unique_equals_join(spark, how):
    rng = random.Random(2)
    left = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else str(rng.randrange(40))) for i in range(600)], "i int, k string"
    )
    right = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(20)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", how).collect()))
    for min_rows in (1, 50, 10_000):
        assert sorted(map(tuple, join_unique(left, right, "k", how, min_rows).collect())) == want


def simple_cycles(edges):
    nodes = sorted({n for e in edges for n in e})
    after = {n: sorted({d for s, d in edges if s == n}) for n in nodes}
    out = []

    def walk(start, path):
        for nxt in after[path[-1]]:
            if nxt == start:
                out.append(list(path))
            elif nxt > start and nxt not in path:
                walk(start, [*path, nxt])

    for n in nodes:
        walk(n, [n])
    return sorted(out, key=lambda c: (len(c), c))


def found_cycles(df, **options):
    return sorted((list(r.cycle) for r in graph.include_cycles(df, **options).collect()), key=lambda c: (len(c), c))


# A part of any size goes to one task; then nothing fits into one; then some parts do.
@pytest.mark.parametrize(("seed", "part_edges"), [(0, 200_000), (1, 200_000), (1, 6)])
def test_cycles_against_brute_force(spark, seed, part_edges):
    rng = random.Random(seed)
    pairs = {(f"{g}{rng.randrange(7)}", f"{g}{rng.randrange(7)}") for _ in range(14) for g in "nm"}
    pairs |= {("n0", "m0"), ("k1", "k2"), ("k2", "k1"), ("k2", "n1")}
    df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    assert found_cycles(df, part_edges=part_edges) == simple_cycles(pairs)
    short = found_cycles(df, part_edges=part_edges, max_length=2)
    assert short == [c for c in simple_cycles(pairs) if len(c) <= 2]


@pytest.mark.parametrize("seed", range(40))
def test_search_within_a_task(seed):
    rng = random.Random(seed)
    size = rng.randrange(2, 8)
    pairs = {(a, b) for a in range(size) for b in range(size) if a != b and rng.random() < 0.35}
    out = {a: [b for b in range(size) if (a, b) in pairs] for a in range(size)}
    want = simple_cycles(pairs)
    for shares in (1, 3):
        got = [c for k in range(shares) for c in cycles.simple_cycles(out, k, shares)]
        assert sorted(got, key=lambda c: (len(c), c)) == want
    short = sorted(cycles.simple_cycles(out, most=3), key=lambda c: (len(c), c))
    assert short == [c for c in want if len(c) <= 3]


def diamonds(n):
    """A chain of two-way diamonds: two cycles each, and two ways on from each to the next."""
    ways = [(f"c{k:04}", f"{s}{k:04}") for k in range(n) for s in "ab"]
    ways += [(f"{s}{k:04}", f"c{k + 1:04}") for k in range(n) for s in "ab"]
    return ways + [(f"c{k + 1:04}", f"c{k:04}") for k in range(n)]


@pytest.mark.parametrize("n", [30, 3000])
def test_diamonds_have_two_cycles_each(spark, n):
    started = time.time()
    got = found_cycles(spark.createDataFrame(diamonds(n), "src string, dst string"))
    assert got == sorted([f"{s}{k:04}", f"c{k + 1:04}", f"c{k:04}"] for k in range(n) for s in "ab")
    assert time.time() - started < 60


def test_long_ladders(spark):
    """A thousand files in two rails: one way it has no cycle, closed at one end one for each rung."""
    started = time.time()
    rails = [(f"a{k:03}", f"a{k + 1:03}") for k in range(499)] + [(f"b{k + 1:03}", f"b{k:03}") for k in range(499)]
    rungs = [(f"a{k:03}", f"b{k:03}") for k in range(500)]
    ladder = rails + rungs
    make = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    assert found_cycles(make(ladder)) == []
    got = found_cycles(make([*ladder, ("b000", "a000")]))
    assert [len(c) for c in got] == [2 * k for k in range(1, 501)]
    chain = [(f"n{k:04}", f"n{k + 1:04}") for k in range(1000)]
    assert len(found_cycles(make(chain + [(b, a) for a, b in chain]))) == 1000
    assert time.time() - started < 60


def test_weak_components(spark):
    rng = random.Random(5)
    pairs = [(f"p{k:03}", f"p{k + 1:03}") for k in range(300)] + [("hub", f"s{k}") for k in range(50)]
    pairs += [(f"r{a}", f"r{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(40)) if a != b]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    found = {r.node: r.part for r in graph.weak_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert set(found) == set(parent)
    groups = lambda of: sorted(sorted(n for n in parent if of(n) == g) for g in {of(n) for n in parent})
    assert groups(root) == groups(found.get)


def test_cutting_keeps_all_cycles(spark):
    rng = random.Random(11)
    # Rings joined by one-way bridges.
    pairs = {(f"r{r}n{i}", f"r{r}n{(i + 1) % 4}") for r in range(5) for i in range(4)}
    pairs |= {(f"r{a}n{rng.randrange(4)}", f"r{b}n{rng.randrange(4)}") for a in range(5) for b in range(a)}
    df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    core = graph.cut_between_components(df)
    assert sorted(map(tuple, core.collect())) == sorted(p for p in pairs if p[0][:2] == p[1][:2])
    got = found_cycles(df)
    assert got == simple_cycles(pairs)


def test_no_cycle_in_a_chain(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string")
    assert graph.include_cycles(chain).collect() == []


@pytest.mark.parametrize("length", [200, 2000])
def test_long_chains_have_no_cycle(spark, length):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(length)]
    assert graph.include_cycles(spark.createDataFrame(pairs, "src string, dst string")).collect() == []


def test_long_rings_are_one_cycle_each(spark):
    ring = [(f"a{i:03}", f"a{(i + 7) % 150:03}") for i in range(150)]
    # A second ring with a chord, so its two cycles share a run; a chain runs from one ring to the other.
    other = [(f"b{i:03}", f"b{(i + 1) % 120:03}") for i in range(120)] + [("b040", "b100")]
    bridge = [("a000", "c0"), ("c0", "c1"), ("c1", "b000"), ("b000", "b000")]
    df = spark.createDataFrame(ring + other + bridge, "src string, dst string")
    got = found_cycles(df)
    names = [f"b{i:03}" for i in range(120)]
    long_ring = [f"a{7 * i % 150:03}" for i in range(150)]
    assert got == [["b000"], names[:41] + names[100:], names, long_ring]


def test_no_edges_have_no_cycles(spark):
    assert graph.include_cycles(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_measures(spark, listing):
    nodes = listing("a.php", "b.php", "index.php", "self.php", "xindex.php")
    edges = spark.createDataFrame(
        [("a.php", "b.php"), ("index.php", "b.php"), ("self.php", "self.php")], "src string, dst string"
    )
    degrees = {r.node: r.in_degree for r in graph.in_degree(nodes, edges).collect()}
    assert degrees == {"a.php": 0, "b.php": 2, "index.php": 0, "self.php": 1, "xindex.php": 0}
    hubs = [tuple(r) for r in graph.top_hubs(nodes, edges, 3).collect()]
    assert hubs == [("b.php", 2), ("self.php", 1), ("a.php", 0)]
    orphans = {
        p: sorted(r.node for r in graph.orphan_files(nodes, edges, p).collect())
        for p in ("line", "span", "block")
    }
    assert orphans == {
        "line": ["a.php", "index.php", "xindex.php"],
        "span": ["a.php", "xindex.php"],
        "block": ["a.php"],
    }
    assert tuple(graph.graph_stats(nodes, edges).first()) == (5, 3)
    assert graph.has_edge(edges, "a.php", "b.php").first().has_edge
    assert not graph.has_edge(edges, "b.php", "a.php").first().has_edge
    assert [r.node for r in graph.successors(edges, "a.php").collect()] == ["b.php"]


def test_include_of_a_folder_form_names_the_file(spark, listing):
    from riskloom.operators.includes import resolve_includes

    raws = [("a.php", "lib/"), ("a.php", "lib/."), ("a.php", "x/../lib")]
    includes = spark.createDataFrame(raws, "src string, raw string")
    found = resolve_includes(includes, listing("a.php", "lib.php"), "span")
    assert {r.raw: r.dst for r in found.collect()} == dict.fromkeys((raw for _, raw in raws), "lib.php")


def test_includes_are_read_once(spark, listing):
    from riskloom.operators.includes import resolve_includes

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raws = [("a.php", "lib"), ("b.php", "./lib.php"), ("b.php", "/x/../a"), ("x/c.php", "../lib.php"), ("x/c.php", "none")]
    ddl = "src string, raw string"
    includes = spark.createDataFrame(raws, ddl).mapInArrow(count, ddl)
    for profile in ("line", "span", "block"):
        read.value = 0
        found = resolve_includes(includes, listing("a.php", "b.php", "lib.php", "x/c.php"), profile, heavy_min_rows=2)
        got = {(r.src, r.raw, r.dst) for r in found.collect()}
        assert read.value == len(raws) and ("x/c.php", "../lib.php", "lib.php") in got
        if profile == "span":
            assert got == {("a.php", "lib", "lib.php"), ("b.php", "./lib.php", "lib.php"), ("b.php", "/x/../a", "a.php"), ("x/c.php", "../lib.php", "lib.php")}


def test_assignment_pattern_is_linear_in_a_word(spark):
    import time

    from riskloom.operators import rules, scan

    texts = spark.createDataFrame([("a.txt", "a" * 300_000 + "key" + "b" * 300_000)], "path string, text string")
    started = time.time()
    scan.run_rules(texts, [rules.PLAIN_ASSIGNMENT], "span").count()
    assert time.time() - started < 60
