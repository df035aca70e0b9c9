"""Groups and overlaps of sorted ends, without hashing or sorting them anew."""

import random

import numpy as np

from riskloom.llm import alignment


def test_overlaps_merge_sorted_ends(monkeypatch):
    monkeypatch.setattr(np, "union1d", None)
    pick = random.Random(5)
    for _ in range(200):
        n = pick.randint(1, 40)
        a, b = (np.array(sorted({*pick.sample(range(1, n + 1), pick.randint(0, n)), n})) for _ in range(2))
        found = {*zip(*(x.tolist() for x in alignment.overlaps(a, b)))}
        begins = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        wanted = {(i, j) for i in range(len(a)) for j in range(len(b)) if begins[0][i] < b[j] and begins[1][j] < a[i]}
        assert found == wanted
        shared = sorted({*a.tolist()} & {*b.tolist()})
        names, group_a, group_b = alignment.components(a, b)
        assert a[names].tolist() == shared
        assert group_a.tolist() == np.searchsorted(shared, a).tolist()
        assert group_b.tolist() == np.searchsorted(shared, b).tolist()
    empty = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in (*alignment.overlaps(empty, empty), *alignment.components(empty, empty))] == [0] * 5
