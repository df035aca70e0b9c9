"""Links, vectors and walks by cells of nodes."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import neighbours


def nodes_of(spark, x):
    rows = [(k, (v / np.linalg.norm(v)).astype(np.float16).tobytes()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, half binary").repartition(3)


def test_a_vector_goes_to_a_cell_once(spark):
    pick = np.random.default_rng(3)
    nodes = nodes_of(spark, pick.normal(size=(200, 5))).withColumn("worst", F.lit(-9.0).cast("float"))
    lists = [(k, [int(n) for n in pick.choice(200, 12, replace=False) if n != k]) for k in range(200)]
    graph = spark.createDataFrame([(k, near, [True] * len(near)) for k, near in lists], "id long, near array<long>, fresh array<boolean>")
    met = neighbours._met(neighbours._links(graph, 8, 4), nodes, 4).collect()
    sent = [(r.cell, i) for r in met if r.kind == neighbours.NODES for i in np.frombuffer(r.a, np.int64).tolist()]
    asked = [(r.cell, i) for r in met if r.kind == neighbours.LINKS for i in np.frombuffer(r.b, np.int64).tolist()]
    assert len(sent) == len(set(sent)) and set(sent) == set(asked) and len({c for c, _ in sent}) == 4 and len(asked) > 3 * len(sent)


def test_many_cells_and_turns_find_what_one_finds(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, x[0].tolist()), (901, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = []
    for cell, size in ((2_000, 8 << 20), (90, 150)):
        monkeypatch.setattr(neighbours, "CELL", cell)
        monkeypatch.setattr(neighbours, "QUERY_BYTES", size)
        found.append(sorted(tuple(r) for r in neighbours.nearest(frame, "vec_id % 25 = 0", k=5, beam=40).collect()))
    # Sums of other orders may differ in the last bits of a similarity, not in what is near.
    assert len(found[0]) == 13 * 5 and len(set(found[0]) & set(found[1])) >= 0.95 * len(found[0])
