"""Token alignment, hard negatives and token counts against brute force, with odd rows and clashing columns."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskloom.llm import alignment, hardneg, tokencount
from riskloom.llm.queries import QUERIES, TOKENIZER
from riskloom.llm.tokens import TokenEncoder

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [*"ab é'7- \t\n\x0b\x0c\r\x1c\x1f\x85 　 ÅÅΣ’漢🙂́‍İß▁", "<|endoftext|>", "<s>", "<0x41>", "Å", " the", "Σ "]
DOCS = "doc_id long, text string, `row` int, link string, n_a int, lang string, word string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a\0b"), (6, "same"), (6, "same"), (None, "no id"), (None, None)]


def mixed(rows, seed):
    pick = random.Random(seed)
    return [(k, "".join(pick.choices(SIGNS, k=pick.randint(0, 50)))) for k in range(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1, "x", 2, "xx", "y") for i, t in rows], DOCS).repartition(3)


# ------------------------------------------------------------- op11


def aligned_by_hand(rows):
    tool = alignment.Sides(TOKENIZER, PIECES)
    found = []
    for i, text in rows:
        text = text or ""
        sides = []
        for ids, table in (
            (tool.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, tool.bytes_a),
            (tool.b.encode(text), tool.bytes_b),
        ):
            at, spans = 0, []
            for k in ids:
                spans.append((k, at, at + len(table[k])))
                at = spans[-1][2]
            same = text and b"".join(table[k] for k in ids) == (" " + text).encode()
            sides.append(spans if same else None)
        a, b = sides if None not in sides else ([], [])
        links = [(x, y) for x, s, e in a for y, t, u in b if s < u and t < e]
        groups, since = [], 0
        for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(k) for k, s, _ in side if since <= s < cut) for side in (a, b)))
            since = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((i, len(a), len(b), len(groups), links, digest))
    n = Counter(x for d in found for x in set(d[4]))
    top = defaultdict(int)
    for (a, _), many in n.items():
        top[a] = max(top[a], many)
    return Counter(
        (i, a, b, g, len(x), sum(n[p] == top[p[0]] for p in x), sum(n[p] for p in x), h) for i, a, b, g, x, h in found
    )


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_LINKS, 30, 0])
def test_alignment(docs, frequent):
    rows = [*mixed(150, 1), *ODD, (7, "wordier words " * 200), (8, "<|endoftext|> <s>")]
    got = alignment.align_tokenizers(docs(rows), TOKENIZER, PIECES, frequent)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    expected = aligned_by_hand(rows)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == expected
    assert sum(n for r, n in expected.items() if r[1]) > 80


def test_alignment_of_long_and_no_texts(spark, docs):
    long = " ".join(f"word{k % 977}" for k in range(200_000))
    (row,) = alignment.align_tokenizers(docs([(1, long)]), TOKENIZER, PIECES).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_best <= row.n_links == row.count_sum
    assert alignment.align_tokenizers(docs([(1, "x")]).limit(0), TOKENIZER, PIECES).count() == 0


def test_successors_end_at_the_last_token_of_a_component():
    pick = np.random.default_rng(4)
    for _ in range(50):
        cuts = [np.unique(np.append(pick.integers(1, 60, pick.integers(1, 30)), 60)) for _ in "ab"]
        names, group_a, group_b = alignment.components(*cuts)
        shared = np.intersect1d(*cuts)
        assert (cuts[0][names] == shared).all()
        assert (group_a == np.searchsorted(shared, cuts[0])).all() and (group_b == np.searchsorted(shared, cuts[1])).all()


def test_a_chain_needs_few_rounds(monkeypatch):
    # Ends that never meet before the last: one component of 200,000 tokens.
    a, b = np.append(np.arange(2, 200_000, 2), 200_001), np.append(np.arange(1, 200_000, 2), 200_001)
    names, group_a, group_b = alignment.components(a, b)
    assert len(names) == 1 and not group_a.any() and not group_b.any()


def test_cache_stays_below_its_bytes(monkeypatch):
    from riskloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 100_000)
    tool = TokenEncoder(TOKENIZER)
    for k in range(5):
        texts = [" ".join(f"w{k}x{j}y{i}" for i in range(60)) for j in range(40)]
        assert tool.encode(texts) == tool.plain(texts)
        assert tool.held <= 100_000 and tool.held == tool._cost(tool.known)
        few = [" ".join(f"u{k}v{i}" for i in range(150))]
        assert tool.encode(few) == tool.plain(few) and 0 < tool.held <= 100_000


# ------------------------------------------------------------- op12


def negatives_by_hand(rows):
    kept = [
        (n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for n, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for key, i, label, v in kept:
        if i % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), j, k, other == label)
            for k, j, other, w in kept
            if k != key and len(w) == len(v)
        )
        for p in [x for x in scored if x[3]][:5]:
            fits = [x for x in scored if not x[3] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:5]
            out += [(i, p[1], k + 1, x[1], -p[0], -x[0]) for k, x in enumerate(fits)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, key int, tree string, bounds int"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def some_vectors(n, seed):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 0.3) for _ in range(6)] for _ in range(20)]
    return [(i, [single(x + pick.gauss(0, 0.05)) for x in pick.choice(centres)], pick.randrange(10)) for i in range(n)]


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    return mined_of(frame, **options)


def mined_of(frame, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(map(tuple, hardneg.mine_negatives(frame, F.col("vec_id") % 100 == 0, label, **options).collect()))


def test_negatives(spark):
    rows = some_vectors(1200, 5)
    same = rows[0][1]
    rows += [(i, same, i % 3) for i in range(1200, 1700)]  # a third alike: ties everywhere
    rows += [
        (100, rows[3][1], 2), (100, None, 1), (None, same, 1), (200, [None] * 6, 1), (201, [1.0, 2.0], 1), (300, [1.0, 2.0], 1),
        (302, [single(0.9), single(1.9)], 2), (400, [math.nan] * 6, 2), (500, [math.inf] * 6, 2), (501, same, None), (600, [], 1),
        (601, [], 1), (602, [], 2), (700, [3e5] * 6, 1), (800, [3e6] * 6, 1), (801, [2e6] * 6, 1), (802, [single(1.9e6)] * 6, 3),
    ]
    got = mined(spark, rows, tree_rows=200)
    assert got == negatives_by_hand(rows) and len(got) > 100


def test_no_negatives(spark):
    frame = spark.createDataFrame([(100, [1.0], 1, 1, "x", 1), (101, [-1.0], 1, 1, "x", 1)], VECTORS)
    assert not mined_of(frame) and not mined_of(frame.limit(0))


def test_a_component_out_of_range_is_an_error(spark):
    frame = spark.createDataFrame([(100, [1e30], 1, 1, "x", 1)], VECTORS)
    with pytest.raises(Exception, match="out of range"):
        mined_of(frame)


def test_boxes_outside_the_windows_are_left_out():
    pick = np.random.default_rng(6)
    points = np.concatenate([pick.integers(-20, 20, (200, 8)) + pick.integers(-300, 300, 8) for _ in range(50)])
    keys = np.arange(len(points))
    tree = hardneg.PackedTree(keys, keys, keys % 10, points, leaf_rows=16, fanout=8)
    leaves = len(tree.levels[-1].start)
    assert (np.sort(tree.keys) == keys).all() and len(tree.levels) > 2
    for level, above in zip(tree.levels[1:], tree.levels, strict=False):
        for k, (a, b) in enumerate(zip(above.start, above.end, strict=True)):
            assert (level.low[a:b] >= above.low[k]).all() and (level.high[a:b] <= above.high[k]).all()
    query = points[77].astype(float)
    scores = points @ points[77]
    top = int(np.sort(scores)[-300])
    for windows in ([(-math.inf, math.inf)], [(0.8 * top, top)], [(0.99 * top, top), (0.5 * top, 0.6 * top)]):
        tree.visited = 0
        got = tree.search(query, 77, 7, False, windows, 5)
        for (least, most), found in zip(windows, got, strict=True):
            fits = sorted((-scores[k], k) for k in keys if k % 10 != 7 and least <= scores[k] <= most)[:5]
            assert [(-s, k, k) for s, k in fits] == found
        assert tree.visited < leaves / 4


def test_negatives_query_matches_by_hand(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = Counter(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).collect()))
    assert got == negatives_by_hand([tuple(r) for r in table]) and got


# ------------------------------------------------------------- op13


@pytest.mark.parametrize("path", [WORDS, TOKENIZER, PIECES])
def test_counts(docs, path):
    rows = [*mixed(1500, 7), *ODD, (7, "word " * 50_000), (8, "x" * 20_000), (9, "<|endoftext|><|startoftext|> <|EndOfText|>")]
    count = tokencount.word_counter(path)[0]
    plain = count([t or "" for _, t in rows])
    expected = Counter((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, plain, strict=True))
    assert Counter(map(tuple, tokencount.count_tokens(docs(rows), path, table_words=40).collect())) == expected


def test_only_the_word_tokenizer_is_cut():
    assert [tokencount.word_counter(p)[1] for p in (WORDS, TOKENIZER, PIECES)] == [True, False, False]


def test_no_rows_to_count(docs):
    assert tokencount.count_tokens(docs([(1, "x")]).limit(0), WORDS).count() == 0


def test_frequent_words_are_bounded(docs):
    rows = [(k, f"the the the of w{k} " + "y" * 100) for k in range(50)]
    found = tokencount.frequent_words(docs(rows), WORDS, most=2)
    assert found.to_pydict() == {"word": ["the", "of"], "n": [1, 1]}


def test_count_cache_stays_below_its_bytes(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 20_000)
    tool = tokencount.CountCache(WORDS)
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(60)]
        assert tool.of(words).tolist() == tool.count(words) and tool.held <= 20_000
    many = [f"z{i}" for i in range(500)]
    assert tool.of(many).tolist() == tool.count(many) and len(tool.known) < 500


def test_counts_query(spark):
    count = tokencount.word_counter(WORDS)[0]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain = count([r.text or "" for r in table])
    expected = Counter((r.doc_id, len((r.text or "").encode()), n, n > 2048) for r, n in zip(table, plain, strict=True))
    assert Counter(map(tuple, QUERIES["op13_token_counts"](spark, SF).collect())) == expected
