"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: a set throws each element into one of ``t`` bins, round after round; a bin keeps the smallest value of its
first round with an element.  Rounds ``t`` to ``2t - 1`` throw all elements into one bin each, so every coordinate is
filled, and two sets agree in a coordinate with the probability of their similarity, with sharp concentration.

Documents with equal sets form one class, whose smallest id stands for it.  Classes that share a band (a run of
coordinates) meet in a bucket.  A bucket's pairs are not all made: its smallest member, the leader, is compared with
all others on full sets, for all buckets at once.  Links join members to components; what is left of a bucket are
pairs across components.  Those that sizes, the distances to the leader (the Jaccard distance is a metric) or one bit
of each coordinate rule out are passed over, and the others are verified block by block inside tasks.  A group of
copies takes work in proportion to its members; only members just short of linked are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WordHashes, flag_among, give_back, groups, mix64, ngram_hashes
from riskloom.llm.components import components
from riskloom.session import materialize

SHINGLE_WORDS = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 32, 6
#: Buckets with more open pairs than this get another leader, up to ``LEADER_ROUNDS``; then blocks are compared.
OPEN_PAIRS = 2_000
LEADER_ROUNDS = 2
#: One bit of each of so many coordinates; open pairs whose bits differ in more places than linked ones do within
#: ``SIGMAS`` standard deviations (a chance of 4 in 100 million) are not verified.
BITS = 256
SIGMAS = 5.5
#: Members compared with one leader in one task.
SPLIT = 2_000
#: Members of a block, and bytes of their sets, about; a task compares two blocks at a time.
BLOCK = 1024
BLOCK_BYTES = 16 << 20

_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary())]
    + [("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
)


def shingle_set(text: str | None, hashes: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word ``k``-grams; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(ngram_hashes(hashes.of(words), min(k, len(words))))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, all sets of a batch in the same rounds; one row each."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    flat, empty = out.ravel(), np.iinfo(np.uint64).max
    for r in range(2 * t):
        h = mix64(items + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = (h % np.uint64(t)).astype(np.int64) if r < t else np.full(len(items), r - t)
        # Earlier rounds have smaller values, so the minimum keeps the first round of each bin.
        np.minimum.at(flat, owner * t + bins, (np.uint64(r) << np.uint64(48)) | (mix64(h) >> np.uint64(16)))
        sets_left = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        unfilled = np.zeros(len(sets), dtype=bool)
        unfilled[sets_left] = (out[sets_left] == empty).any(axis=1)
        keep = unfilled[owner]
        if not keep.any():
            break
        if not keep.all():
            owner, items = owner[keep], items[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), dtype=np.uint64)
    for k in range(rows):
        keys = mix64(keys + np.uint64(k + 1)) ^ sketch[:, k : bands * rows : rows]
    return mix64(keys).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n, set_key, bands, bits`` of each document; no bands and bits for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, hashes, shingle) for t in part.column("text").to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[k] for k in full], max(BITS, bands * rows))
                keys = band_keys(sketch, bands, rows)
                low = np.packbits((sketch[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                found: list = [[] for _ in sets]
                signs: list = [[] for _ in sets]
                for k, row, bit in zip(full, keys, low, strict=True):
                    found[k], signs[k] = row, bit
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
                columns.append(pa.array(signs, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_of.mapInArrow(of, "doc_id long, n long, set_key binary, bands array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, items binary`` of ``docs(doc_id, text, set_key)``: full sets, as sorted hashes, where the key is theirs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                columns = [part.column(c).to_pylist() for c in ("doc_id", "text", "set_key")]
                rows = [(i, shingle_set(t, hashes, shingle).tobytes(), k) for i, t, k in zip(*columns, strict=True)]
                rows = [(i, items) for i, items, k in rows if xxhash.xxh3_128_digest(items) == k]
                ids, items = [r[0] for r in rows], [r[1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["doc_id", "items"]
                )

    return docs.select("doc_id", "text", "set_key").mapInArrow(of, "doc_id long, items binary")


def common_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common``: intersection sizes of full sets for distinct pairs of ids.

    Pairs meet ``b``'s set in a join.  Then rows are dealt by ``a`` and a share number, as many shares as ``a`` has
    thousands of partners, and sorted so that ``a``'s own set comes first in each share: it is sent once for each share,
    not once for each pair, and a task holds two sets at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("shares"))
    sizes = materialize(sizes)
    small = sizes.filter("shares = 1").select("a")
    dealt = pairs.join(sizes.filter("shares > 1"), "a", "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).cast("int").alias("share")
    )
    members = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b")
    heads = small.withColumn("share", F.lit(0)).union(
        sizes.filter("shares > 1").select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    )
    heads = heads.join(sets.withColumnRenamed("doc_id", "a"), "a").select(
        "a", F.lit(None).cast("long").alias("b"), "share", "items"
    )
    rows = heads.union(members.select("a", "b", "share", "items"))
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            a_of, b_of, items = (batch.column(c) for c in ("a", "b", "items"))
            for k in range(batch.num_rows):
                values = np.frombuffer(items[k].as_py(), dtype=np.uint64)
                b = b_of[k].as_py()
                if b is None:
                    head = values
                    continue
                at = np.searchsorted(head, values)
                at[at == len(head)] = 0
                for column, value in zip(out, (a_of[k].as_py(), b, int((head[at] == values).sum())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "common"])

    return rows.select("a", "b", "items").mapInArrow(count, "a long, b long, common long")


def _similar(percent: int):
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def links(reps: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Verified links ``a, b`` that join linked classes ``reps(doc_id, n, bands, bits, set_key, rep)`` to components.

    Here ``doc_id`` numbers the classes; ``rep`` is the id of a document that holds the class's text.

    Every pair of a bucket is verified, already joined through others, or ruled out by sizes or leader distances.
    """
    sizes = reps.select("doc_id", "n")
    held = reps.select("doc_id", "n", F.posexplode("bands").alias("band", "value"))
    shared = held.groupBy("band", "value").agg(F.count("*").alias("m")).filter("m > 1")
    members = held.join(materialize(shared.select("band", "value")), ["band", "value"])
    members = materialize(members.select("band", "value", "doc_id", "n", F.lit(None).cast("long").alias("root")))
    wanted = reps.select("doc_id", "rep", "set_key").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = materialize(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    # Texts that share no bucket stay where they are.
    texts = flag_among(texts, F.col("rep"), wanted, F.col("rep"), "maybe").filter("maybe").join(wanted, "rep")
    sets = materialize(shingle_sets(texts, shingle))
    nothing = reps.sparkSession.createDataFrame([], "a long, b long")
    found, done = nothing, nothing  # links; pairs that have been verified

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"))
        counted = common_counts(pairs, sets)
        counted = counted.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
        return materialize(counted.join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b"))

    measured = None
    for turn in range(LEADER_ROUNDS):
        order = F.struct((F.xxhash64("doc_id", F.lit(turn)) if turn else F.lit(0)).alias("key"), "doc_id", "n")
        leader = members.groupBy("band", "value").agg(F.min(order).alias("first"))
        leader = leader.select("band", "value", F.col("first.doc_id").alias("leader"), F.col("first.n").alias("leader_n"))
        led = members.join(materialize(leader), ["band", "value"])
        open_ = F.col("root").isNull() | (F.col("root") != F.col("leader_root"))
        if turn:
            roots_of = members.select("band", "value", F.col("doc_id").alias("leader"), F.col("root").alias("leader_root"))
            led = led.join(roots_of, ["band", "value", "leader"])
        else:
            led = led.withColumn("leader_root", F.lit(None).cast("long"))
        led = materialize(led)
        near_size = F.least("n", "leader_n") * 100 >= percent * F.greatest("n", "leader_n")
        pairs = (
            led.filter(open_ & near_size & (F.col("doc_id") != F.col("leader")))
            .select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b"))
            .distinct()
        )
        new = verified(pairs)
        measured = new if measured is None else materialize(measured.union(new))
        done = measured.select("a", "b")
        found = measured.filter(_similar(percent)).select("a", "b")
        roots = components(found)
        # The leader has met all members and leaves; a bucket of one component is done.
        known = measured.select(
            F.col("a"), F.col("b"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d")
        )
        both = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        rest = led.filter(F.col("doc_id") != F.col("leader")).drop("root", "leader_root", "leader_n", "d", "m", "total")
        rest = rest.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        rest = rest.withColumn("root", F.coalesce("root", "doc_id"))
        rest = rest.join(both.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), "d"), ["leader", "doc_id"], "left")
        kinds = rest.groupBy("band", "value").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.sum("n").alias("total")
        )
        kinds = materialize(kinds.filter("low <> high").select("band", "value", "m", "total"))
        members = materialize(
            rest.join(kinds, ["band", "value"]).select("band", "value", "doc_id", "n", "root", "d", "m", "total")
        )
        if not members.filter(F.col("m") * F.col("m") > 2 * OPEN_PAIRS).limit(1).count():
            break
    return found.union(_block_links(members, reps, sets, percent))


def _block_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the open pairs of ``members(band, value, doc_id, n, root, d, m, total)``, none of them made as rows.

    A bucket is dealt into blocks and each pair of its blocks to a task, so a member is sent once for each block of its
    bucket.  A pair is looked at in the first band that it shares, and verified on full sets unless its components,
    sizes, leader distances or bits rule it out.
    """
    same = 0.5 + percent / 200
    most = int(BITS * (1 - same + SIGMAS * (same * (1 - same) / BITS) ** 0.5))
    far = 1 - percent / 100 + 1e-9
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    rows = members.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    whole = materialize(reps.select("doc_id", "bands", "bits").join(sets, "doc_id"))
    rows = rows.join(whole, "doc_id")
    keys = ["band", "value", "low", "high"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            ids, n, root, own = (group.column(c).to_numpy() for c in ("doc_id", "n", "root", "own"))
            d = group.column("d").to_numpy().astype(np.float64)  # null: NaN
            bands, bits = (np.array(group.column(c).to_pylist()) for c in ("bands", "bits"))
            bits = bits.view(np.uint64)  # a negative number's bits are counted in its absolute value
            items = [np.frombuffer(x, dtype=np.uint64) for x in group.column("items").to_pylist()]
            band, low, high = (group.column(c)[0].as_py() for c in ("band", "low", "high"))
            root, at = root.copy(), np.arange(len(ids))
            found: tuple[list, list] = ([], [])
            for x in np.flatnonzero(own == low):
                mask = (at > x) if low == high else (own == high)
                mask &= (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
                mask &= ~(np.abs(d - d[x]) > far)
                y = np.flatnonzero(mask)
                y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1) <= most]
                y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
                if not len(y):
                    continue
                place = np.searchsorted(items[x], values := np.concatenate([items[k] for k in y]))
                place[place == len(items[x])] = 0
                starts = np.concatenate([[0], np.cumsum([len(items[k]) for k in y])[:-1]])
                common = np.add.reduceat((items[x][place] == values).astype(np.int64), starts)
                for k in y[100 * common >= percent * (n[y] + n[x] - common)]:
                    found[0].append(ids[x])
                    found[1].append(ids[k])
                    root[root == root[k]] = root[x]
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    wanted = dealt.select(*keys, "doc_id", "n", "root", "d", "own", "bands", "bits", "items")
    return wanted.mapInArrow(check, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id long, text string)``.

    A null, empty or blank text has no shingles and is linked with nothing.  Rows with the same id are one document,
    which is linked through each of its sets; a row with a null id is linked with nothing and kept, with a null component.  Other columns are not
    looked at.  No rows give no rows.
    """
    seen = materialize(signatures(docs, bands, rows, shingle))
    real = seen.filter("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    found = links(classes.withColumnRenamed("node", "doc_id"), docs, percent, shingle)
    # An id that repeats with several sets joins their classes; every class is compared by itself.
    several = real.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low <> high")
    held = real.select("doc_id", "set_key").join(materialize(several.select("doc_id")), "doc_id").distinct()
    held = materialize(held.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node"))
    first = held.groupBy("doc_id").agg(F.min("node").alias("first"))
    same_id = held.join(first, "doc_id").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = materialize(components(found.union(same_id)))
    grouped = classes.select("set_key", "node", "rep").join(roots, "node", "left")
    grouped = materialize(grouped.select("set_key", "rep", F.coalesce("root", "node").alias("root")))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    known = materialize(grouped.join(least, "root").select("set_key", "component"))
    out = seen.select("doc_id", "n", "set_key").join(known, "set_key", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
