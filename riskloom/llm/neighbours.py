"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node.  A further component makes all lengths equal, so that the largest inner product is the
nearest direction.  The graph starts from few random-projection tables: nodes with the same code meet in small groups
and keep their best.  Then rounds of NN-descent: around each node, the nodes that it is linked with,
either way, are compared with each other, as neighbours of neighbours are likely to be near; nodes that many others
link to take these in several groups.  Two nodes are compared around a node only while one of the links is new since
the round before, and nodes without a new link are left out.  Rounds go on until few links change.  A query starts at its
own node and walks to the best nodes found so far until none of its beam is left to open.  Graph and walk use half
precision; final scores are exact.

Nodes are dealt by hash to cells of about ``CELL``.  Links, vectors and proposals travel between cells as few rows with
many values in bytes, and a task works on the arrays of one cell at a time.  A cell that compares around its nodes asks
for each vector once, however many of its nodes link to it; a walk sends ids to the cells that hold the vectors, and
only what may enter the beam comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import groups, mix64
from riskloom.llm.sample import hash_sample
from riskloom.session import materialize

#: Vectors, at most about, that the tables' directions are fitted on.
SAMPLE_ROWS = 8_000
TABLES = 4
#: Nodes that are compared with each other in one group of a table.
LEAF = 100
DEGREE = 32
#: Links from others that a node takes into one comparison, about; more are worked off in several.
REVERSE = 32
#: Rounds end when fewer than this share of links changes; lists only get better, so they do end.
SETTLED = 0.02
BEAM = 160
#: Proposals that a task holds at most, some 20 bytes each; they are cut to each member's best before they are sent on.
HELD_PROPOSALS = 2_000_000
#: Nodes of a cell, about.
CELL = 2_000
#: Bytes of queries, at most about, that walk at once; each task has them all.
QUERY_BYTES = 8 << 20
#: Pairs of a query and a node that are scored at once.
SCORED = 100_000
#: Walks end by themselves; more steps than these are an error.
MAX_STEPS = 200

_LISTS = "id long, near array<long>, sims array<float>"
_LIST_SCHEMA = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])


def _rows(table: pa.Table, column: str, kind) -> np.ndarray:
    """A binary column of equal lengths as a matrix of 32-bit floats."""
    values = table.column(column).to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float32)


def _lists(ids: np.ndarray, sizes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """One list for each id, of the next ``size`` values."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    columns = [pa.array(ids, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in (near, sims.astype(np.float32)))]
    return pa.RecordBatch.from_arrays(columns, schema=_LIST_SCHEMA)


def _best(owner: np.ndarray, other: np.ndarray, sims: np.ndarray, others: int, k: int) -> np.ndarray:
    """Places of the ``k`` best of each owner, by owner and best first, ties to smaller ones; pairs may repeat.

    Owners and others are numbers from 0, the latter below ``others``.
    """
    at = np.unique(owner.astype(np.int64) * others + other, return_index=True)[1]
    owner = owner[at].astype(np.int64)
    bits = sims[at].astype(np.float32).view(np.int32).astype(np.int64)
    rank = (1 << 31) - np.where(bits >= 0, bits, -(bits & 0x7FFFFFFF))
    order = np.argsort((owner << 32) + rank, kind="stable")
    at, owner = at[order], owner[order]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return at[np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at)))) < k]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(values)))


# ---------------------------------------------------------------- cells

#: A row holds values for one cell: up to four columns of numbers, as bytes.
_BLOCKS = "cell int, kind int, a binary, b binary, c binary, d binary"
_BLOCK_SCHEMA = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
OWN, BACK, ASKED, LINKS, NODES, LISTS, PAIRS = range(7)


def _cell_count(nodes: DataFrame) -> int:
    return max(1, -(-nodes.count() // CELL))


def _cell_of(ids: np.ndarray, cells: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(cells)).astype(np.int32)


def _blocks(kind: int, *shares: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """A row for each cell.  Of each share the first column says to which cells the values of the others go."""
    cells, columns = np.zeros(0, dtype=np.int32), []
    for where, *values in shares:
        order = np.argsort(where, kind="stable")
        starts, _ = _runs(where[order])
        cells = where[order][starts]
        columns += [[p.tobytes() for p in np.split(v[order], starts[1:])][: len(cells)] for v in values]
    columns += [[None] * len(cells)] * (4 - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip([cells, np.full(len(cells), kind), *columns], _BLOCK_SCHEMA, strict=True)],
        schema=_BLOCK_SCHEMA,
    )


def _by_cell(blocks: DataFrame, cells: int) -> DataFrame:
    return blocks.repartition(cells, "cell").sortWithinPartitions("cell")


def _read(group: pa.Table, kind: int, *types) -> list[np.ndarray]:
    """The columns of one kind of a cell, rows in the order in which they came."""
    rows = group.filter(pc.equal(group.column("kind"), kind))
    return [np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in zip("abcd", types, strict=False)]


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy()


def _node_blocks(nodes: DataFrame, cells: int) -> DataFrame:
    """Blocks of ``nodes(id, half, worst)``."""

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                half = np.frombuffer(b"".join(batch.column("half").to_pylist()), np.uint8).reshape(len(ids), -1)
                yield _blocks(NODES, (_cell_of(ids, cells), ids, half, batch.column("worst").to_numpy()))

    return nodes.select("id", "half", "worst").mapInArrow(deal, _BLOCKS)


def _list_blocks(ids: np.ndarray, sizes: np.ndarray, near: np.ndarray, sims: np.ndarray, cells: int) -> pa.RecordBatch:
    where = _cell_of(ids, cells)
    return _blocks(LISTS, (where, ids, sizes.astype(np.int32)), (np.repeat(where, sizes), near, sims.astype(np.float32)))


def _read_nodes(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, vectors and worst similarities of the nodes in a cell's blocks."""
    ids, half, worst = _read(group, NODES, np.int64, np.float16, np.float32)
    order = np.argsort(ids, kind="stable")
    return ids[order], half.reshape(len(ids), -1 if len(ids) else 0)[order], worst[order]


def _places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the ordered ``ids``, and where these are."""
    if not len(ids):
        return np.zeros(len(wanted), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    there = ids[at] == wanted
    return there, at[there]


def valid_vectors(frame: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec``: vectors that take part, as doubles.

    Null ids and vectors take no part, nor vectors that are zero, or hold a null or a number that is not finite, or
    are of another length than most (the longer, if two are as frequent).  Of rows that repeat an id, the largest vector takes part.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = frame.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.filter(F.size("vec") == (sizes["size"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.max("vec").alias("vec"))


def _nodes(classes: DataFrame) -> DataFrame:
    """``id, half``: directions of equal length in half precision."""
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    top = classes.agg(F.max(squares)).first()[0] or 1.0

    def of(batches):
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            rest = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
            half = (np.column_stack([x, rest]) / np.sqrt(top)).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in half], pa.binary())], names=["id", "half"]
            )

    return classes.select("id", "vec").mapInArrow(of, "id long, half binary")


def _codes(nodes: DataFrame, count: int, tables: int, leaf: int) -> DataFrame:
    """``id, t, code``: in each table, on which side of the median of each random direction a node lies."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / (0.8 * leaf))))))
    sample = hash_sample(nodes.withColumnRenamed("id", "doc_id"), SAMPLE_ROWS).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["half"], dtype=np.float16) for r in sample], dtype=np.float32)
    random = np.random.default_rng(20)
    picks = random.integers(len(x), size=(2, tables * bits)) if bits else np.zeros((2, 0), dtype=int)
    directions = x[picks[0]] - x[picks[1]]
    medians = np.median(x @ directions.T, axis=0) if bits else np.zeros(0)

    def of(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            v = _rows(pa.Table.from_batches([batch]), "half", np.float16)
            side = (v @ directions.T > medians).reshape(len(v), tables, bits)
            code = (side * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("id").to_numpy(), tables)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))),
                    pa.array(code.ravel()),
                ],
                names=["id", "t", "code"],
            )

    return nodes.mapInArrow(of, "id long, t int, code long")


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of neighbours that may repeat, ties to smaller ids."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], sims[first]


def start_lists(nodes: DataFrame, count: int, tables: int, leaf: int, degree: int) -> DataFrame:
    codes = materialize(_codes(nodes, count, tables, leaf))
    sizes = codes.groupBy("t", "code").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
    dealt = codes.join(materialize(sizes), ["t", "code"], "left").select(
        "id", "t", "code", F.coalesce(F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("n") / leaf)), F.lit(0)).alias("part")
    )
    keys = ["t", "code", "part"]
    met = dealt.join(nodes, "id").repartition(*keys).sortWithinPartitions(*keys, "id")

    def best(batches):
        for group in groups(batches, keys, 2 * leaf):
            ids, x = group.column("id").to_numpy(), _rows(group, "half", np.float16)
            k = min(degree, len(ids) - 1)
            if k < 1:
                continue
            for a in range(0, len(ids), 500):
                sims = x[a : a + 500] @ x.T
                sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
                at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield _lists(ids[a : a + 500], np.full(len(at), k), ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel())

    return met.select("id", "half", *keys).mapInArrow(best, _LISTS)


def _lone_lists(nodes: DataFrame, graph: DataFrame, degree: int) -> DataFrame:
    """Lists for nodes that met too few others in the tables: ``degree`` sampled nodes, the same for all."""
    lone = nodes.join(graph.filter(F.size("near") >= degree).select("id"), "id", "left_anti")
    some = nodes.orderBy(F.xxhash64("id"), "id").limit(degree + 1).collect()
    targets = np.array([r["id"] for r in some], dtype=np.int64)
    y = np.array([np.frombuffer(r["half"], dtype=np.float16) for r in some], dtype=np.float32)

    def of(batches):
        for batch in batches:
            if batch.num_rows and len(targets) > 1:
                sims = _rows(pa.Table.from_batches([batch]), "half", np.float16) @ y.T
                ids = batch.column("id").to_numpy()
                own = [_top(targets[targets != i], r[targets != i], degree) for i, r in zip(ids, sims, strict=True)]
                near, best = (np.concatenate(c) for c in zip(*own, strict=True))
                yield _lists(ids, np.array([len(n) for n, _ in own]), near, best)

    return lone.mapInArrow(of, _LISTS)


def _merged(lists: DataFrame, degree: int, cells: int = 1, found: DataFrame | None = None) -> DataFrame:
    """One list for each node, of the best of all its lists, which are not empty; ``found`` are further ones, or blocks of such."""

    def deal(batches):
        for batch in batches:
            near, sims = batch.column("near"), batch.column("sims")
            yield _list_blocks(batch.column("id").to_numpy(), _sizes(near), near.flatten().to_numpy(), sims.flatten().to_numpy(), cells)

    def best(v, w, s):
        owners, owner = np.unique(v, return_inverse=True)
        others, other = np.unique(w, return_inverse=True)
        at = _best(owner, other, s, len(others), degree)
        return v[at], w[at], s[at]

    def merge(batches):
        for group in groups(batches, ["cell"]):
            held: list[tuple] = []
            waiting = 0
            for row in range(group.num_rows):
                ids, sizes, near, sims = _read(group.slice(row, 1), LISTS, np.int64, np.int32, np.int64, np.float32)
                held.append((np.repeat(ids, sizes), near, sims))
                waiting += len(near)
                if waiting > HELD_PROPOSALS:
                    held[:] = [best(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    waiting = 0
            v, w, s = best(*(np.concatenate(c) for c in zip(*held, strict=True)))
            starts, sizes = _runs(v)
            yield _lists(v[starts], sizes, w, s)

    parts = [f if "cell" in f.columns else f.mapInArrow(deal, _BLOCKS) for f in (lists, found) if f is not None]
    return materialize(_by_cell(reduce(DataFrame.union, parts), cells).mapInArrow(merge, _LISTS))


def _links(graph: DataFrame, reverse: int, cells: int = 1) -> DataFrame:
    """``centre, part, members``: all links of each node, those from others dealt by hash to parts of about ``reverse``.

    Each part has the node's own links too.  Members are ``id, fresh``; a link both ways is there twice.  Without a column
    ``fresh`` in ``graph`` all links are.
    """
    graph = graph if "fresh" in graph.columns else graph.withColumn("fresh", F.transform("near", lambda _: F.lit(True)))

    def deal(batches):
        for batch in batches:
            centre = np.repeat(batch.column("id").to_numpy(), _sizes(batch.column("near")))
            member = batch.column("near").flatten().to_numpy()
            fresh = batch.column("fresh").flatten().to_numpy(zero_copy_only=False)
            yield _blocks(OWN, (_cell_of(centre, cells), centre, member, fresh))
            yield _blocks(BACK, (_cell_of(member, cells), member, centre, fresh))

    def link(batches):
        for group in groups(batches, ["cell"]):
            own, own_member, own_fresh = _read(group, OWN, np.int64, np.int64, bool)
            centre, member, fresh = _read(group, BACK, np.int64, np.int64, bool)
            centres, at, count = np.unique(centre, return_inverse=True, return_counts=True)
            parts = -(-count // reverse)
            part = mix64(mix64(centre.astype(np.uint64)) ^ member.astype(np.uint64)) % parts[at].astype(np.uint64)
            times = np.ones(len(own), dtype=np.int64)
            linked, at = _places(centres, own)
            times[linked] = parts[at]
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            centre, part = np.concatenate([centre, np.repeat(own, times)]), np.concatenate([part.astype(np.int64), each])
            member, fresh = (np.concatenate([b, np.repeat(o, times)]) for b, o in ((member, own_member), (fresh, own_fresh)))
            order = np.lexsort((~fresh, member, part, centre))
            centre, part, member, fresh = centre[order], part[order], member[order], fresh[order]
            new = np.ones(len(centre), dtype=bool)
            new[1:] = (centre[1:] != centre[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            for a in range(0, len(starts), CELL):
                first, end = starts[a : a + CELL], starts[a + CELL] if a + CELL < len(starts) else len(centre)
                members = pa.StructArray.from_arrays([pa.array(c[first[0] : end]) for c in (member, fresh)], ["id", "fresh"])
                ends = pa.array(np.append(first, end) - first[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(centre[first]), pa.array(part[first]), pa.ListArray.from_arrays(ends, members)],
                    names=["centre", "part", "members"],
                )

    schema = "centre long, part long, members array<struct<id:long,fresh:boolean>>"
    dealt = graph.select("id", "near", "fresh").mapInArrow(deal, _BLOCKS)
    return _by_cell(dealt, cells).mapInArrow(link, schema)


def _met(links: DataFrame, nodes: DataFrame, cells: int) -> DataFrame:
    """Blocks of ``links`` with a fresh member, and of ``nodes(id, half, worst)`` in them, once for each cell.

    Parts of a node go to different cells.
    """

    def ask(batches):
        for batch in batches:
            centre, members = batch.column("centre").to_numpy(), batch.column("members")
            sizes, member = _sizes(members), members.flatten()
            member, fresh = member.field("id").to_numpy(), member.field("fresh").to_numpy(zero_copy_only=False)
            # Members are in the order of their centres, and each centre has some.
            some = np.add.reduceat(fresh, np.cumsum(sizes) - sizes, dtype=np.int64) > 0 if len(sizes) else np.zeros(0, dtype=bool)
            kept = np.repeat(some, sizes)
            part, sizes, member, fresh = batch.column("part").to_numpy()[some], sizes[some], member[kept], fresh[kept]
            where = _cell_of(np.where(part > 0, mix64(centre[some].astype(np.uint64)) + part.astype(np.uint64), centre[some].astype(np.uint64)), cells)
            each = np.repeat(where, sizes)
            yield _blocks(LINKS, (where, sizes), (each, member, fresh))
            ids, at = np.unique(member, return_inverse=True)
            asked = np.unique(each * np.int64(len(ids)) + at)
            asker, asked = (asked // max(1, len(ids))).astype(np.int32), ids[asked % max(1, len(ids))]
            yield _blocks(ASKED, (_cell_of(asked, cells), asker, asked))

    def answer(batches):
        for group in groups(batches, ["cell"]):
            ids, half, worst = _read_nodes(group)
            asker, asked = _read(group, ASKED, np.int32, np.int64)
            there, at = _places(ids, asked)
            pairs = np.unique(asker[there] * np.int64(max(1, len(ids))) + at)
            asker, at = (pairs // max(1, len(ids))).astype(np.int32), pairs % max(1, len(ids))
            yield _blocks(NODES, (asker, ids[at], half[at], worst[at]))

    blocks = materialize(links.mapInArrow(ask, _BLOCKS))
    asked = _node_blocks(nodes, cells).union(blocks.filter(F.col("kind") == ASKED))
    answers = _by_cell(asked, cells).mapInArrow(answer, _BLOCKS)
    return _by_cell(answers.union(blocks.filter(F.col("kind") == LINKS)), cells)


def descend(graph: DataFrame, nodes: DataFrame, degree: int, reverse: int, cells: int = 1, in_blocks: bool = False) -> DataFrame:
    """One round: members around each node are compared; what beats a member's worst neighbour is kept for it.

    Gives lists, or blocks of them for ``_merged``.
    """
    worst = graph.select("id", F.when(F.size("sims") >= degree, F.array_min("sims")).otherwise(F.lit(-9.0)).cast("float").alias("worst"))
    known = nodes.join(worst, "id", "left").select("id", "half", F.coalesce("worst", F.lit(-9.0).cast("float")).alias("worst"))

    def better(batches):
        for group in groups(batches, ["cell"]):
            ids, half, worst = _read_nodes(group)
            sizes, member, fresh = _read(group, LINKS, np.int32, np.int64, bool)
            for lists in _proposals(ids, half.astype(np.float32), worst, sizes, member, fresh, degree):
                yield _list_blocks(*lists, cells) if in_blocks else _lists(*lists)

    return _met(_links(graph, reverse, cells), known, cells).mapInArrow(better, _BLOCKS if in_blocks else _LISTS)


def _proposals(
    ids: np.ndarray, x: np.ndarray, worst: np.ndarray, sizes: np.ndarray, member: np.ndarray, fresh: np.ndarray, degree: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lists, as ids, sizes, neighbours and similarities, of what beats the ``worst`` of a node ``ids, x``, out of groups of ``sizes`` members; ids are in order."""
    there, at = _places(ids, member)
    key = np.repeat(np.arange(len(sizes)), sizes)[there] * np.int64(max(1, len(ids))) + at
    order = np.lexsort((~fresh[there], key))
    key, fresh = key[order], fresh[there][order]
    firsts, _ = _runs(key)
    key, fresh = key[firsts], fresh[firsts]
    place = key % max(1, len(ids))
    held: list[tuple] = []

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held, each member's best ``degree`` only: no list keeps more of the union of all."""
        v, w, s = (np.concatenate(c) for c in zip(*held, strict=True))
        kept = _best(v, w, s, len(ids), degree)
        return v[kept], w[kept], s[kept]

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v, w, s = held[0]
        held.clear()
        starts, counts = _runs(v)
        return ids[v[starts]], counts, ids[w], s

    waiting = 0
    for start, size in zip(*_runs(key // max(1, len(ids))), strict=True):
        near = place[start : start + size]
        new = np.flatnonzero(fresh[start : start + size])
        if not len(new) or size < 2:
            continue
        rows, least, own = x[near], worst[near], near[new]
        sims = rows[new] @ rows.T
        sims[np.arange(len(new)), new] = -np.inf
        a, b = np.nonzero(sims > least[new][:, None])
        to_new = (own[a], near[b], sims[a, b])
        # What both rows of two fresh members hold is looked at once.
        least[new] = np.inf
        a, b = np.nonzero(sims > least)
        if len(a) + len(to_new[0]):
            held.append(tuple(np.concatenate(c) for c in zip(to_new, (near[b], own[a], sims[a, b]), strict=True)))
            waiting += len(held[-1][0])
        if waiting > HELD_PROPOSALS:
            held[:] = [packed()]
            waiting = len(held[0][0])
            if waiting > HELD_PROPOSALS // 2:
                yield flush()
                waiting = 0
    if held:
        held[:] = [packed()]
        yield flush()


def build_graph(nodes: DataFrame, tables: int = TABLES, leaf: int = LEAF, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """``id, near, sims``: the neighbour graph of ``nodes(id, half)``."""
    count, cells = nodes.count(), _cell_count(nodes)
    graph = _merged(start_lists(nodes, count, tables, leaf, degree), degree, cells)
    graph = _merged(graph.union(_lone_lists(nodes, graph, degree)), degree, cells)
    while True:
        lists = graph.select("id", "near", "sims")
        new = _merged(lists, degree, cells, descend(graph, nodes, degree, reverse, cells, True))
        old = F.coalesce("old", F.array().cast("array<long>"))
        both = new.join(graph.select("id", F.col("near").alias("old")), "id", "left")
        graph = materialize(both.select("id", "near", "sims", F.transform("near", lambda x: ~F.array_contains(old, x)).alias("fresh")))
        changed = graph.agg(
            F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("near")).alias("all")
        ).first()
        if not changed["all"] or changed["new"] < SETTLED * changed["all"]:
            return graph.select("id", "near", "sims")


def walk(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int, reverse: int) -> DataFrame:
    """``query, near``: for ``queries(query, id, half)`` the beam of nodes that the walk from ``id`` ends with.

    So many walk at once that their vectors are bounded.
    """
    cells = _cell_count(nodes)
    roads = materialize(_links(graph, reverse, cells).select("centre", F.array_distinct("members.id").alias("next")))
    known = materialize(_node_blocks(nodes.withColumn("worst", F.lit(0.0).cast("float")), cells))
    size = queries.agg(F.coalesce(F.sum(F.octet_length("half")), F.lit(0))).first()[0]
    turns = max(1, -(-size // QUERY_BYTES))
    turn = F.pmod(F.xxhash64("query"), F.lit(turns))
    ends = [_walk(roads, known, queries.filter(turn == n), beam, cells) for n in range(turns)]
    return reduce(DataFrame.union, ends)


def _walk(roads: DataFrame, known: DataFrame, queries: DataFrame, beam: int, cells: int) -> DataFrame:
    """``query, near`` of ``queries``, whose vectors every task gets."""
    found = queries.select("query", "half").toArrow().sort_by("query")
    names = found.column("query").to_numpy()
    q = _rows(found, "half", np.float16) if len(names) else np.zeros((0, 0), dtype=np.float32)

    def ask(batches):
        for batch in batches:
            sizes, ids = _sizes(batch.column("next")), batch.column("next").flatten().to_numpy()
            query = np.searchsorted(names, batch.column("query").to_numpy()).astype(np.int32)
            least = batch.column("least").to_numpy()
            yield _blocks(PAIRS, (_cell_of(ids, cells), ids, np.repeat(query, sizes), np.repeat(least, sizes)))

    def score(batches):
        for group in groups(batches, ["cell"]):
            ids, half, _ = _read_nodes(group)
            wanted, query, least = _read(group, PAIRS, np.int64, np.int32, np.float32)
            there, at = _places(ids, wanted)
            query, least, kept = query[there], least[there], []
            for a in range(0, len(at), SCORED):
                who, node = query[a : a + SCORED], at[a : a + SCORED]
                sims = np.einsum("ij,ij->i", half[node].astype(np.float32), q[who])
                good = sims >= least[a : a + SCORED]
                kept.append((who[good], node[good], sims[good]))
            if kept:
                who, node, sims = (np.concatenate(c) for c in zip(*kept, strict=True))
                best = _best(who, node, sims, len(ids), beam)
                starts, counts = _runs(who[best])
                yield _lists(names[who[best][starts]], counts, ids[node[best]], sims[best])

    # State: the beam, best first, and which of it have been opened; the own node is a member like others.
    state = queries.select("query", F.array("id").alias("near"), F.array(F.lit(9.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("opened"))
    state = materialize(state)
    for _ in range(MAX_STEPS):
        closed = F.filter(F.arrays_zip("near", "opened"), lambda s: ~s["opened"])
        # A node that is no better than the worst of a full beam does not enter it.
        least = F.when(F.size("sims") >= beam, F.array_min("sims")).otherwise(F.lit(-9.0)).cast("float").alias("least")
        opening = state.select("query", least, F.explode(closed).alias("s")).select("query", "least", F.col("s.near").alias("centre"))
        opening = materialize(opening)  # of known size: few of them go to the roads, which then stay
        if not opening.limit(1).count():
            return state.select("query", "near")
        asked = opening.join(roads, "centre").select("query", "least", "next").mapInArrow(ask, _BLOCKS)
        scored = _by_cell(known.union(asked), cells).mapInArrow(score, _LISTS)
        dealt = state.select("query", "near", "sims", F.lit(0).alias("r")).union(scored.select("id", "near", "sims", F.lit(1)))
        dealt = dealt.repartition("query").sortWithinPartitions("query", "r")

        def step(batches):
            rows: list[list] = [[], [], [], []]
            for group in groups(batches, ["query"]):
                near, sims = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("near", "sims"))
                size = len(group.column("near")[0])
                # The first row is the beam.
                fresh = np.append(np.ones(size, dtype=bool), ~np.isin(near[size:], near[:size]))
                new, best = _top(near[fresh], sims[fresh], beam)
                values = (group.column("query")[0].as_py(), new, best, np.isin(new, near[:size]))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                if len(rows[0]) == 1000:
                    yield out(rows)
                    rows = [[], [], [], []]
            if rows[0]:
                yield out(rows)

        def out(rows):
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["query", "near", "sims", "opened"]
            )

        state = materialize(dealt.mapInArrow(step, "query long, near array<long>, sims array<float>, opened array<boolean>"))
    raise RuntimeError(f"walks still have open members after {MAX_STEPS} steps")


def nearest(
    frame: DataFrame,
    is_query: str,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for rows where ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``.  A row is no candidate for itself.  Fewer than ``k`` candidates: all that
    are found.  See ``valid_vectors`` for rows that take no part.  Other columns are not looked at.
    """
    vectors = materialize(valid_vectors(frame, id_col, vec_col))
    classes = materialize(vectors.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    nodes = materialize(_nodes(classes))
    graph = build_graph(nodes)
    repeated = materialize(classes.filter("n > 1").select("vec", "id"))
    members = vectors.join(repeated, "vec")
    order = Window.partitionBy("id").orderBy("vec_id")
    # Of equal vectors, no more than k + 1 can be among the nearest of a query, itself included.
    first = materialize(
        members.select("id", "vec_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    )
    queries = vectors.filter(is_query)
    node_of = queries.join(repeated.withColumnRenamed("id", "node"), "vec", "left").select(
        F.col("vec_id").alias("query"), F.coalesce("node", "vec_id").alias("id"), "vec"
    )
    # Queries are not lengthened: their further component is 0.
    flat = materialize(node_of.select("query", "id", _packed(F.col("vec")).alias("half")))
    ends = walk(graph, nodes, flat, max(beam, k + 1), REVERSE)
    found = ends.select("query", F.explode("near").alias("id"))
    found = found.join(first, "id", "left").select("query", F.coalesce("vec_id", "id").alias("vec_id")).filter("query <> vec_id")
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = (
        found.join(vectors.withColumnRenamed("vec", "b"), "vec_id")
        .join(queries.select(F.col("vec_id").alias("query"), F.col("vec").alias("a")), "query")
        .select(F.col("query").alias("query_id"), "vec_id", exact.alias("score"))
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(vec: Column) -> Column:
    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        rows = [np.asarray(v, dtype=np.float64) for v in values]
        return pd.Series([np.append(r / np.linalg.norm(r), 0.0).astype(np.float16).tobytes() for r in rows])

    return of(vec)
