"""Hard negatives by inner product, from R-trees packed by sort-tile-recursive (STR).

Rows are dealt by ranges of their coordinates into parts of bounded size; each part becomes one packed tree, a single
row of bytes.  A node's minimum bounding box gives, coordinate by coordinate, the interval in which a component of the
inner product with an anchor lies, and their sums bound every score below the node.  A search takes nodes from a queue,
highest upper bound first, and leaves out boxes that lie outside all score windows, and boxes that lie strictly below
the k-th score found so far.  Blocks of anchors meet the trees by tree number; what the trees find is merged by rank.
The first search finds an anchor's positives, the second the negatives within the windows that the positives set.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this many hundredths of its positive's, and no higher than it.
LEAST_PERCENT = 80
#: Rows of one tree at most; rows of a leaf; children of a node above.
TREE_ROWS = 1 << 16
LEAF_ROWS = 128
FANOUT = 16
#: Anchors of one block, and blocks that one task puts to one tree.
BLOCK_ROWS = 256
TASK_BLOCKS = 32

_PACKED_DDL = "tree long, part int, place long, width int, n int, keys binary, ids binary, labels binary, scaled binary, scores binary"
_PACKED = pa.schema(
    [("tree", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("width", pa.int32()), ("n", pa.int32())]
    + [(c, pa.binary()) for c in ("keys", "ids", "labels", "scaled", "scores")]
)
_FOUND_DDL = "anchor long, anchor_id long, target long, bound long, score long, found_id long, found long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "target", "bound", "score", "found_id", "found")])


def exact_matrix(scaled: np.ndarray) -> np.ndarray:
    """Integers in a form whose inner products are exact: doubles while all sums stay below 2**53, else Python integers."""
    most = float(np.abs(scaled).max()) if scaled.size else 0.0
    return scaled.astype(np.float64) if most * most * max(1, scaled.shape[1]) < 2.0**53 else scaled.astype(object)


@dataclass
class Level:
    """Nodes of one level: boxes, and the range of children (rows, at the lowest) of each."""

    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    end: np.ndarray


def str_order(points: np.ndarray, leaf_rows: int) -> np.ndarray:
    """Rows in packing order: slabs along the widest coordinate, each cut into slabs along the next, and so on."""
    n, width = points.shape
    pages = -(-n // leaf_rows)
    if pages < 2 or not width:
        return np.arange(n)
    spread = np.var(points.astype(np.float64), axis=0)
    axes = np.argsort(-spread, kind="stable")[: max(1, int(np.log2(pages)))]
    pending = [(np.arange(n), 0)]
    done: list[np.ndarray] = []
    while pending:
        rows, depth = pending.pop()
        pages = -(-len(rows) // leaf_rows)
        rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        if depth == len(axes) - 1 or pages < 2:
            done.append(rows)
            continue
        slabs = int(np.ceil(pages ** (1 / (len(axes) - depth))))
        size = leaf_rows * -(-pages // slabs)
        pending += [(rows[k : k + size], depth + 1) for k in reversed(range(0, len(rows), size))]
    return np.concatenate(done)


class PackedTree:
    """An R-tree over ``scaled`` rows; ``levels`` from the root down to the leaves."""

    def __init__(self, keys, ids, labels, scaled: np.ndarray, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT):
        order = str_order(scaled, leaf_rows)
        self.keys, self.ids, self.labels = keys[order], ids[order], labels[order]
        self.rows = exact_matrix(scaled[order])
        starts = np.arange(0, len(order), leaf_rows)
        ends = np.minimum(starts + leaf_rows, len(order))
        level = Level(
            np.array([self.rows[a:b].min(axis=0) for a, b in zip(starts, ends, strict=True)]),
            np.array([self.rows[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)]),
            starts,
            ends,
        )
        self.levels = [level]
        while len(level.start) > 1:
            starts = np.arange(0, len(level.start), fanout)
            ends = np.minimum(starts + fanout, len(level.start))
            level = Level(
                np.array([level.low[a:b].min(axis=0) for a, b in zip(starts, ends, strict=True)]),
                np.array([level.high[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)]),
                starts,
                ends,
            )
            self.levels.insert(0, level)
        self.visited = 0  # leaves looked into

    def search(self, query: np.ndarray, key: int, label: int, same: bool, windows: list[tuple[float, float]], k: int) -> list[list]:
        """For each window ``(least, most)`` the first ``k`` rows ``(score, id, key)`` whose label is or isn't the anchor's.

        Higher scores come first, ties by smaller id, then by key; the anchor's own row takes no part.
        """
        if self.rows.dtype != query.dtype:  # one of both needs Python integers
            query = np.array([int(x) for x in query], dtype=object)
        above, below = np.maximum(query, 0), np.minimum(query, 0)
        kept: list[list] = [[] for _ in windows]  # heaps of (score, -id, -key): the worst first
        floors = [least for least, _ in windows]
        most = max(m for _, m in windows)
        queue: list[tuple] = []

        def push(depth: int, a: int, b: int) -> None:
            level = self.levels[depth]
            highest = level.high[a:b] @ above + level.low[a:b] @ below
            lowest = level.low[a:b] @ above + level.high[a:b] @ below
            bar = min(floors)
            for j in np.flatnonzero((highest >= bar) & (lowest <= most)).tolist():
                heapq.heappush(queue, (-highest[j], depth, a + j, lowest[j]))

        push(0, 0, len(self.levels[0].start))
        while queue:
            negative, depth, node, lowest = heapq.heappop(queue)
            if -negative < min(floors):
                break
            if not any(-negative >= f and lowest <= m for f, (_, m) in zip(floors, windows, strict=True)):
                continue
            level = self.levels[depth]
            a, b = int(level.start[node]), int(level.end[node])
            if depth + 1 < len(self.levels):
                push(depth + 1, a, b)
                continue
            self.visited += 1
            scores = self.rows[a:b] @ query
            fits = (self.labels[a:b] == label) == same
            fits &= (scores >= min(floors)) & (scores <= most) & (self.keys[a:b] != key)
            for j in np.flatnonzero(fits).tolist():
                entry = (int(scores[j]), -int(self.ids[a + j]), -int(self.keys[a + j]))
                for w, (least, top) in enumerate(windows):
                    if not least <= entry[0] <= top:
                        continue
                    heap = kept[w]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floors[w] = max(least, heap[0][0])
        return [[(s, -i, -r) for s, i, r in sorted(heap, reverse=True)] for heap in kept]


def _pack(tree: int, part: int, place: int, width: int, keys, ids, labels, scaled: np.ndarray, scores=b"") -> tuple:
    small = np.abs(scaled).max() < 2**15 if scaled.size else True
    data = scaled.astype("<i2" if small else "<i8").tobytes()
    return (tree, part, place, width, len(keys), *(np.asarray(x).astype("<i8").tobytes() for x in (keys, ids, labels)), data, scores)


def _unpack(row: dict) -> tuple:
    keys, ids, labels = (np.frombuffer(row[c], dtype="<i8") for c in ("keys", "ids", "labels"))
    n, width = row["n"], row["width"]
    kind = "<i2" if len(row["scaled"]) == 2 * n * width else "<i8"
    return keys, ids, labels, np.frombuffer(row["scaled"], dtype=kind).reshape(n, width).astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _floor(x: Column) -> Column:
    """The integer below; a component whose integer is out of a long's range is an error, never a clipped value."""
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("component out of range")).cast("long"))


def usable_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """``(key, vec_id, label, scaled)`` of rows that take part; ``key`` tells rows with one id apart."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    scaled = F.transform("embedding", lambda x: _floor(F.lit(float(SCALE)) * x.cast("double")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding")
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", scaled.alias("scaled"))


def _packed(rows: DataFrame, size: int, tree: bool) -> DataFrame:
    """Rows of each task packed by width into byte rows of at most ``size``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}

        def flush(width: int) -> pa.RecordBatch:
            nonlocal place
            keys, ids, labels, scaled, scores = zip(*held.pop(width), strict=True)
            block = np.concatenate([x.reshape(1, width) for x in scaled])
            bounds = b"".join(np.array([len(s), *s], dtype="<i8").tobytes() for s in scores)
            row = _pack(place if tree else -1, 0, place, width, keys, ids, labels, block, bounds)
            place += 1
            return _batch([row], _PACKED)

        for batch in batches:
            column = batch.column("scaled")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            scores = batch.column("bounds").to_pylist()
            for k, (key, i, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "vec_id", "label")), strict=True)):
                x = flat[ends[k] : ends[k + 1]].astype(np.int64)
                held.setdefault(len(x), []).append((key, i, label, x, scores[k]))
                if len(held[len(x)]) >= size:
                    yield flush(len(x))
        for width in [*held]:
            yield flush(width)

    return rows.select("key", "vec_id", "label", "scaled", "bounds").mapInArrow(pack, _PACKED_DDL)


def pack_trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Trees as rows of bytes: the first cut of the packing is by ranges of the leading coordinates, over all rows.

    ``key`` ends the order, so that any number of equal vectors is cut into parts too.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // max(1, tree_rows // 2)))
    ordered = rows.withColumn("bounds", F.array().cast("array<long>"))
    ordered = ordered.repartitionByRange(int(parts), *(F.get("scaled", F.lit(k)) for k in range(3)), "key")
    return materialize(_packed(ordered, tree_rows, True))


def _search(trees: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """What each tree finds for each anchor; ``bounds`` of an anchor are the highest scores of its windows, if any."""
    blocks = materialize(_packed(anchors, BLOCK_ROWS, False))
    parts = max(1, -(-blocks.count() // TASK_BLOCKS))
    part = F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int")
    at = trees.select("tree", "width")
    to_trees = blocks.drop("tree").withColumn("part", part).join(at, "width").select(trees.columns)
    copies = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(trees.columns)
    both = copies.withColumn("kind", F.lit(0)).unionByName(to_trees.withColumn("kind", F.lit(1)))
    both = both.repartition("tree", "part").sortWithinPartitions("tree", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in (batch.slice(j, 1).to_pylist()[0] for j in range(batch.num_rows)):
                keys, ids, labels, scaled = _unpack(row)
                if row["kind"] == 0:
                    tree = PackedTree(keys, ids, labels, scaled)
                    continue
                bounds = np.frombuffer(row["scores"], dtype="<i8").tolist()
                queries = exact_matrix(scaled)
                if queries.dtype != object and tree.rows.dtype != object:
                    # Exact apart does not mean exact together.
                    most = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.rows).max(initial=0))
                    queries = queries.astype(np.int64).astype(object) if most * max(1, row["width"]) >= 2.0**53 else queries
                out, at = [], 0
                for key, i, label, query in zip(keys.tolist(), ids.tolist(), labels.tolist(), queries, strict=True):
                    tops = bounds[at + 1 : at + 1 + bounds[at]]
                    at += 1 + bounds[at]
                    windows = [(-(-LEAST_PERCENT * t // 100), t) for t in tops] if not same else [(-float("inf"), float("inf"))]
                    if windows:
                        hits = tree.search(query, key, label, same, windows, k)
                        for w, found in enumerate(hits):
                            top = tops[w] if not same else 0
                            out += [(key, i, w, top, s, j, r) for s, j, r in found]
                if out:
                    yield _batch(out, _FOUND)

    found = both.mapInArrow(search, _FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "found_id", "found"))
    return materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k))


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Hard negatives of the rows of ``vectors(vec_id, embedding, label)`` that ``anchors`` (on ``vec_id``) picks.

    Components become ``floor(256 * x)`` and scores are exact integers.  An anchor's positives are its ``positives``
    highest other rows of its label, its negatives for each positive the ``negatives`` highest rows of other labels
    that score from 80 % of the positive's score up to all of it (none, if that score is negative).  Ties go to the
    smaller id.  Null ids and labels, null vectors, and null or non-finite components take no part.  Rows are compared
    with rows of their own length; rows that share an id are rows of their own.  No rows give no rows; an anchor
    without positives or negatives has none in the result.  Other columns are not looked at.  Scores beyond the range
    of a long fail with an error.
    """
    rows = materialize(usable_rows(vectors, label if label is not None else F.col("label")))
    trees = pack_trees(rows, tree_rows)
    picked = rows.filter(anchors)
    best = _search(trees, picked.withColumn("bounds", F.array().cast("array<long>")), True, positives)
    best = best.select("anchor", F.col("rank").alias("nth"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # At most ``positives`` rows an anchor.
    tops = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("tops"))
    asked = picked.join(tops, F.col("key") == F.col("anchor")).withColumn("bounds", F.col("tops.positive_score"))
    found = _search(trees, asked, False, negatives)
    found = found.withColumn("nth", F.col("target").cast("int") + 1).join(best, ["anchor", "nth"])
    return found.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
