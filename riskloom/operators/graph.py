"""Measures over ``nodes(path)`` and ``edges(src, dst)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.paths import basename
from riskloom.model import Profile, profile_of
from riskloom.operators import cycles
from riskloom.operators.skew import join_unique
from riskloom.session import materialize, run_dir

#: Edges that one task may hold for the cycle search (some 40 MB of names and lists).
PART_EDGES = 200_000
#: A part goes to one more task for each so many edges, and to so many at most.
SHARE_EDGES = 200
MOST_SHARES = 64
#: Nodes of found cycles that a task holds before it sends them on.
HELD_NODES = 200_000

# Names that are entry points, not orphans (span profile).
ENTRY_NAMES = ("index.php", "main.php", "app.php", "bootstrap.php")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, in_degree)`` with zeros, in one shuffle and without a join.

    Ones for edge targets and zeros for nodes are summed, so a hub is already
    combined on the map side.
    """
    ones = edges.select(F.col("dst").alias("node"), F.lit(1).cast("long").alias("hit"))
    zeros = nodes.select(F.col("path").alias("node"), F.lit(0).cast("long").alias("hit"))
    return ones.unionAll(zeros).groupBy("node").agg(F.sum("hit").alias("in_degree"))


def top_hubs(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return in_degree(nodes, edges).orderBy(F.desc("in_degree"), "node").limit(n)


def is_entry_point(node: Column, profile: str | Profile) -> Column:
    name = profile_of(profile).name
    if name == "span":
        return F.lower(basename(node)).isin(*ENTRY_NAMES)
    if name == "block":
        return F.contains(node, F.lit("index.php"))
    return F.lit(False)


def orphan_files(nodes: DataFrame, edges: DataFrame, profile: str | Profile) -> DataFrame:
    """``(node)`` nothing includes; entry points left out as the profile says."""
    return (
        in_degree(nodes, edges)
        .filter((F.col("in_degree") == 0) & ~is_entry_point(F.col("node"), profile))
        .select("node")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(nodes, edges)``."""
    flagged = nodes.select(F.lit(1).alias("is_node")).unionAll(edges.select(F.lit(0)))
    return flagged.agg(
        F.coalesce(F.sum("is_node"), F.lit(0)).cast("long").alias("nodes"),
        F.count_if(F.col("is_node") == 0).alias("edges"),
    )


def successors(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("node"))


def has_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row ``(has_edge)``."""
    return edges.filter((F.col("src") == src) & (F.col("dst") == dst)).agg(
        (F.count("*") > 0).alias("has_edge")
    )


def _degrees(edges: DataFrame) -> DataFrame:
    """``(node, ins, outs)``, combined on the map side."""
    ones = edges.select(F.col("src").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs")).unionAll(
        edges.select("dst", F.lit(1), F.lit(0))
    )
    return ones.groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))


def _follow(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of pointers ``(node, at, hops, done)``, and what lies on rings as ``(node, least)``.

    Each round doubles the hops, so rounds grow with the logarithm of the longest run.  On a run that ends, some node
    arrives in each round; when none does and no least name falls either, the rest are rings that know their least
    node.
    """
    state = materialize(pointers.withColumn("least", F.col("node")))
    while True:
        further = state.select(
            F.col("node").alias("at"),
            F.col("at").alias("to"),
            F.col("hops").alias("more"),
            F.col("done").alias("arrived"),
            F.col("least").alias("other"),
        )
        ended = state.filter("done").withColumn("moved", F.lit(False))
        step = state.filter("NOT done").join(further, "at")
        step = step.select(
            "node",
            F.col("to").alias("at"),
            (F.col("hops") + F.col("more")).alias("hops"),
            F.col("arrived").alias("done"),
            F.least("least", "other").alias("least"),
            (F.col("arrived") | (F.col("other") < F.col("least"))).alias("moved"),
        )
        state = materialize(ended.unionByName(step))
        if state.filter("moved").isEmpty():
            return state.filter("done").select("node", "at", "hops"), state.filter("NOT done").select("node", "least")
        state = state.drop("moved")


def _contract(core: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, walks)``: runs of ``inner`` nodes, which have one way in and one out, become single edges.

    An edge's ``path`` lists the nodes between its ends, so cycles stay one to one.  Closed runs are cycles already.
    A node is held in one path at most, so the table does not grow.
    """
    at_src = inner.select(F.col("node").alias("src"), F.lit(True).alias("src_inner"))
    at_dst = inner.select(F.col("node").alias("dst"), F.lit(True).alias("dst_inner"))
    marked = materialize(core.join(at_src, "src", "left").join(at_dst, "dst", "left"))
    onward = marked.filter("src_inner").withColumnRenamed("src", "node")
    last = F.col("dst_inner").isNull()
    ended, on_rings = _follow(
        onward.select(
            "node",
            F.when(last, F.col("node")).otherwise(F.col("dst")).alias("at"),
            F.when(last, 0).otherwise(1).cast("long").alias("hops"),
            last.alias("done"),
        )
    )
    # A ring is opened before its least node, which so comes first.
    opened = onward.join(on_rings, "node")
    last = F.col("dst") == F.col("least")
    ring_ends, _ = _follow(
        opened.select(
            "node",
            F.when(last, F.col("node")).otherwise(F.col("dst")).alias("at"),
            F.when(last, 0).otherwise(1).cast("long").alias("hops"),
            last.alias("done"),
        )
    )
    members = ended.withColumn("ring", F.lit(False)).unionAll(ring_ends.withColumn("ring", F.lit(True)))
    members = members.join(onward.select("node", "path", "dst"), "node")
    runs = members.groupBy("at", "ring").agg(
        F.sort_array(F.collect_list(F.struct("hops", "node", "path")), asc=False).alias("steps"),
        F.max(F.when(F.col("hops") == 0, F.col("dst"))).alias("end"),
    )
    nodes = F.flatten(F.transform("steps", lambda s: F.concat(F.array(s["node"]), s["path"])))
    runs = materialize(runs.select("ring", "end", F.get("steps", F.lit(0))["node"].alias("dst"), nodes.alias("nodes")))
    heads = marked.filter("src_inner IS NULL AND dst_inner").select("src", "dst", "path")
    joined = heads.join(runs.filter("NOT ring"), "dst").select(
        "src", F.col("end").alias("dst"), F.concat("path", "nodes").alias("path")
    )
    whole = marked.filter("src_inner IS NULL AND dst_inner IS NULL").select("src", "dst", "path")
    edges = materialize(whole.unionByName(joined))
    loops = edges.filter("src = dst").select(F.concat(F.array("src"), "path").alias("walk"))
    return edges.filter("src <> dst"), runs.filter("ring").select(F.col("nodes").alias("walk")).unionAll(loops)


def trim_acyclic(core: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges ``(src, dst, path)`` that may lie on a cycle, and cycles found on the way.

    Contracting runs and dropping edges without a way in or on take turns until neither changes anything, so a chain
    takes one turn however long it is.
    """
    walks: list[DataFrame] = []
    size = core.count()
    while size:
        degrees = materialize(_degrees(core))
        inner = degrees.filter("ins = 1 AND outs = 1").select("node")
        contracted = not inner.isEmpty()
        if contracted:
            core, found = _contract(core, inner)
            walks.append(found)
        live = degrees.filter("ins > 0 AND outs > 0").select("node")
        kept = materialize(join_unique(core, live.withColumnRenamed("node", "src"), "src", "left_semi"))
        core = materialize(join_unique(kept, live.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        remaining = core.count()
        if remaining == size and not contracted:
            break
        size = remaining
    return core, walks


def _least_reaching(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node from which each node can be reached.

    Labels are passed along edges until none changes.  Every round combines
    labels on the map side, so a popular target costs no more than others.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    labels = materialize(ends.groupBy("node").agg(F.min("node").alias("label")))
    while True:
        source = labels.select(F.col("node").alias("src"), "label")
        passed = join_unique(edges, source, "src").select(F.col("dst").alias("node"), "label")
        own = labels.select("node", "label", F.col("label").alias("old"))
        arrived = passed.select("node", "label", F.lit(None).cast("string").alias("old"))
        merged = materialize(
            own.unionAll(arrived).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        labels = merged.select("node", "label")
        if merged.filter("label <> old").isEmpty():
            return labels


def cut_between_components(edges: DataFrame) -> DataFrame:
    """Drop edges whose ends cannot both lie on one cycle; other columns stay.

    Nodes of a strongly connected part are reached from the same nodes, so ends
    with different labels belong to different parts.  Labels alternate between
    the graph and its reverse until neither cuts an edge.
    """
    core = edges
    size = core.count()
    untouched = turns = 0
    while size and untouched < 2:
        turned = core.select("src", "dst") if turns % 2 == 0 else core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        labels = _least_reaching(turned)
        at_src = labels.select(F.col("node").alias("src"), F.col("label").alias("src_label"))
        at_dst = labels.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
        labelled = materialize(join_unique(core, at_src, "src"))
        same = join_unique(labelled, at_dst, "dst").filter("src_label = dst_label")
        core = materialize(same.select(*edges.columns))
        remaining = core.count()
        untouched = untouched + 1 if remaining == size else 0
        size, turns = remaining, turns + 1
    return core


def cycle_core(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(edges, walks)``: contracted edges left for the cycle search, and the cycles that contraction found."""
    plain = edges.select("src", "dst").distinct().withColumn("path", F.array().cast("array<string>"))
    plain = materialize(plain)
    loops = plain.filter("src = dst").select(F.array("src").alias("walk"))
    core, walks = trim_acyclic(plain.filter("src <> dst"))
    more: list[DataFrame] = []
    if not core.isEmpty():
        core, more = trim_acyclic(cut_between_components(core))
    return core, [loops, *walks, *more]


def weak_components(edges: DataFrame) -> DataFrame:
    """``(node, part)``: each node's connected component, named by one of its nodes.

    Every node hooks onto its smallest neighbour, pointers are doubled until they reach a root, and edges are drawn
    between roots, until none is left: rounds grow with the logarithm of the graph, not with its length.
    """
    links = materialize(edges.select("src", "dst").distinct())
    labels = None
    while not links.isEmpty():
        ways = links.unionAll(links.select("dst", "src"))
        state = ways.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
        state = materialize(state.select("node", F.least("node", "near").alias("at")))
        while True:
            further = state.select(F.col("node").alias("at"), F.col("at").alias("to"))
            step = join_unique(state, further, "at").select("node", F.col("to").alias("at"), (F.col("to") < F.col("at")).alias("moved"))
            step = materialize(step)
            state = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        if labels is None:
            labels = state.withColumnRenamed("at", "part")
        else:
            roots = state.select(F.col("node").alias("part"), "at")
            labels = materialize(labels.join(roots, "part", "left").select("node", F.coalesce("at", "part").alias("part")))
        drawn = join_unique(links, state.select(F.col("node").alias("src"), F.col("at").alias("from")), "src")
        drawn = join_unique(drawn, state.select(F.col("node").alias("dst"), F.col("at").alias("to")), "dst")
        links = materialize(drawn.filter(F.col("from") != F.col("to")).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct())
    return labels if labels is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0)


def trim(core: DataFrame, size: int, enough: int) -> tuple[DataFrame, int]:
    """Drop edges whose ends lack a way in or on, until ``enough`` are left or a round drops less than one in eight.

    Searches drop what is left over themselves, so stopping early costs no result.
    """
    while size > enough:
        live = _degrees(core).filter("ins > 0 AND outs > 0").select("node")
        kept = join_unique(core, live.withColumnRenamed("node", "src"), "src", "left_semi")
        core = materialize(join_unique(kept, live.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        before, size = size, core.count()
        if size > before - before // 8:
            break
    return core, size


def _split(core: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``(edges with part and n, edges of parts larger than most)``: whole weakly connected parts."""
    labels = weak_components(core).withColumnRenamed("node", "src")
    marked = materialize(join_unique(core, labels, "src"))
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"))
    sized = materialize(join_unique(marked, sizes, "part"))
    return sized.filter(F.col("n") <= most), sized.filter(F.col("n") > most).select("src", "dst")


def _cycles_within(edges: DataFrame, max_length: int | None) -> DataFrame:
    """``(walk)`` of all cycles in ``edges(src, dst, part, n)``, each part at most as large as one task may hold.

    A part with many edges goes to several tasks, each of which looks for the cycles of its share of smallest nodes.
    """
    shares = F.least(F.lit(MOST_SHARES), F.lit(1) + F.floor(F.col("n") / SHARE_EDGES)).cast("int")
    dealt = edges.select("part", "src", "dst", shares.alias("shares"))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.repartition("part", "share").sortWithinPartitions("part", "share")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: tuple, pairs: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            names = sorted({name for pair in pairs for name in pair})
            number = {name: k for k, name in enumerate(names)}
            out: dict[int, list[int]] = {k: [] for k in range(len(names))}
            for src, dst in pairs:
                out[number[src]].append(number[dst])
            walks, held = [], 0
            for walk in cycles.simple_cycles(out, key[1], key[2], max_length):
                walks.append([names[k] for k in walk])
                held += len(walk)
                if held >= HELD_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(walks, pa.list_(pa.string()))], names=["walk"])
                    walks, held = [], 0
            if walks:
                yield pa.RecordBatch.from_arrays([pa.array(walks, pa.list_(pa.string()))], names=["walk"])

        key, pairs = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "share", "shares", "src", "dst")]
            for *own, src, dst in zip(*columns, strict=True):
                if tuple(own) != key:
                    if pairs:
                        yield from found(key, pairs)
                    key, pairs = tuple(own), []
                pairs.append((src, dst))
        if pairs:
            yield from found(key, pairs)

    return dealt.mapInArrow(search, "walk array<string>")


def include_cycles(edges: DataFrame, max_length: int | None = None, part_edges: int = PART_EDGES) -> DataFrame:
    """``(length, cycle)``: all simple cycles, each rotated to its smallest node.

    Edges that cannot lie on a cycle go first, while there are more than ``part_edges``.  What is left goes to tasks in
    whole connected parts of at most that many edges, where cycles are searched block by block.  A larger connected
    part is cut between its strongly connected parts; one of these that is still larger is searched level by level
    over tables, which is exact too but slow.  ``max_length`` leaves out longer cycles when given.
    """
    plain = materialize(edges.select("src", "dst").distinct())
    walks = [plain.filter("src = dst").select(F.array("src").alias("walk"))]
    core = plain.filter("src <> dst")
    core, size = trim(core, core.count(), part_edges)
    if size <= part_edges:
        # One bounded part, which may hold many connected ones.
        walks.append(_cycles_within(core.select("*", F.lit("").alias("part"), F.lit(size).cast("long").alias("n")), max_length))
    else:
        parts, larger = _split(core, part_edges)
        walks.append(_cycles_within(parts, max_length))
        if not larger.isEmpty():
            parts, larger = _split(cut_between_components(larger), part_edges)
            walks.append(_cycles_within(parts, max_length))
            if not larger.isEmpty():
                walks.append(_search_by_levels(larger, max_length))
    found = walks[0]
    for more in walks[1:]:
        found = found.unionByName(more)
    if max_length is not None:
        found = found.filter(F.size("walk") <= max_length)
    return materialize(found.select(F.size("walk").alias("length"), F.col("walk").alias("cycle")))


def _search_by_levels(edges: DataFrame, max_length: int | None) -> DataFrame:
    """``(walk)``: paths grow level by level from every possible smallest node over larger nodes only.

    Runs of nodes with one way in and out are walked in one step; each level is written.
    """
    core, found = cycle_core(edges)
    folder = run_dir(edges.sparkSession, "cycles")
    walks = found[0]
    for more in found[1:]:
        walks = walks.unionByName(more)
    walks.write.parquet(folder)
    steps = core.select(F.col("src").alias("node"), "dst", "path")
    paths = core.filter("dst > src").select(
        F.col("src").alias("start"), F.col("dst").alias("node"), F.concat(F.array("src"), "path", F.array("dst")).alias("walk")
    )
    paths = materialize(paths)
    while not paths.isEmpty():
        back = F.col("dst") == F.col("start")
        fresh = (F.col("dst") > F.col("start")) & ~F.array_contains("walk", F.col("dst"))
        walk = F.when(back, F.concat("walk", "path")).otherwise(F.concat("walk", "path", F.array("dst")))
        level = paths.join(steps, "node").filter(back | fresh)
        level = level.select("start", F.col("dst").alias("node"), walk.alias("walk"), back.alias("closed"))
        if max_length is not None:
            level = level.filter(F.size("walk") <= max_length)
        level = materialize(level)
        level.filter("closed").select("walk").write.mode("append").parquet(folder)
        paths = level.filter("NOT closed").drop("closed")
    cycles_found = edges.sparkSession.read.schema("walk array<string>").parquet(folder)
    at = F.array_position("walk", F.array_min("walk")).cast("int")
    return cycles_found.select(F.concat(F.slice("walk", at, F.size("walk")), F.slice("walk", F.lit(1), at - 1)).alias("walk"))
