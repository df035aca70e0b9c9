"""Operators against brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import glob
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check import rows_of
from riskloom.llm import bitplanes, decontaminate, language, linededup, neardup, neighbours, packing, quality, sample, toxicity, warc
from riskloom.llm.common import WordHashes, flag_among
from riskloom.llm.queries import ORACLES, QUERIES, TOKENIZER
from riskloom.llm.tokens import TokenEncoder
from riskloom.session import run_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_chars long, shard int, lines_before string, words int, a long"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, LONG), (7, LONG + " end"),
    (8, "repeated row of five words"), (8, "repeated row of five words"), (None, "no id at all"), (None, None), (9, "…¿!?"),
]


@pytest.fixture(scope="module")
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "xx", 1, 7, "x", 2, 3) for i, t in rows], SCHEMA).repartition(3)

    return make


def test_units_have_the_ids_of_whole_texts():
    tool, pick = TokenEncoder(TOKENIZER), random.Random(3)
    signs = [*"abAB  '\n\t.,!19éßж漢🙂\xa0​᠎\x00\x1c\x85", "<|endoftext|>", "'s", " the", " and"]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 60))) for _ in range(2000)]
    assert tool.by_unit and tool.encode(texts) == tool.plain(texts)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), kind) == ids).all()


def test_checksums_of_parts_combine():
    data = random.Random(2).randbytes(5000)
    assert bitplanes.shifted_crc(zlib.crc32(data[:1234]), 5000 - 1234) ^ zlib.crc32(data[1234:]) == zlib.crc32(data)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_written_ids(spark, docs, kind):
    folder = run_dir(spark, "ids")
    bitplanes.write_ids(docs(ODD), folder, TOKENIZER, block_ids=4096, kind=kind)
    tool = Tokenizer.from_file(TOKENIZER)
    got = sorted(map(tuple, bitplanes.document_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    want = {}
    for i, t in ODD:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for i, at, n, crc in got:
        assert at == start and (n, crc) in want[i]
        start += n
    assert bitplanes.read_index(spark, folder).count() == bitplanes.read_ids(spark, folder).count()


def test_no_ids(spark, docs):
    folder = run_dir(spark, "ids")
    bitplanes.write_ids(docs(ODD).limit(0), folder, TOKENIZER)
    assert bitplanes.document_digests(spark, folder).count() == 0


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (16, 3, 16), (64, 8, 20)])
def test_packing_keeps_limits_and_ids(docs, limits):
    from pyspark.sql import functions as F

    tokens, segments, loss = limits
    found = packing.pack_documents(
        docs(ODD[:6] + ODD[7:]), TOKENIZER, max_tokens=tokens, max_segments=segments, max_loss=loss, pool=4,
        loss_from=F.when(F.col("doc_id") % 2 == 0, 5), with_ids=True,
    ).collect()
    by_sequence, total = {}, 0
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        total += r.length
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= tokens and len(rows) <= segments and sum(r.loss_tokens for r in rows) <= loss
    tool = Tokenizer.from_file(TOKENIZER)
    assert total == sum(len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD[:6] + ODD[7:])
    assert packing.pack_documents(docs(ODD).limit(0), TOKENIZER).count() == 0


def test_loser_tree_merges():
    pick = random.Random(5)
    for k in range(9):
        runs = [sorted((pick.choice("abc"), "t", pick.randint(0, 9), f"f{r}", n) for n in range(pick.randint(0, 7))) for r in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc._order)


def test_archives(spark):
    body = "x" * 200
    rows = [(3, "http://www.b.org/x", body), (1, "https://a.b.org:8443/?q#f", body), (2, None, None), (4, "b a\nd", "é" * 60), (5, "http://[", "")]
    rows += [(4, "http://b.org/x", "é" * 60), (None, "http://b.org/", body)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, digest string")
    folder = run_dir(spark, "warc")
    index = warc.merge_runs(warc.write_archives(pages, folder, archive_bytes=300), merge_entries=3)
    order = [(r.urlkey, r.captured, r.page_id or -1) for r in index.orderBy("slice", "position").collect()]
    assert order == sorted(order) and len(order) == 7
    got = warc.read_archives(index, folder, with_payload=True).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None)]
        + [(4, "response", None), (0, "revisit", 1)],
        key=lambda r: (r[0], r[1]),
    )
    assert {len(r.payload) for r in got if r.record_type == "revisit"} == {0}
    empty = run_dir(spark, "warc")
    assert warc.read_archives(warc.merge_runs(warc.write_archives(pages.limit(0), empty)), empty).count() == 0


def brute_line_runs(texts, least):
    """Texts without later copies, by looking at all stretches of lines."""
    lines = {i: [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in texts.items()}
    places = {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                places.setdefault(tuple(x for _, x in lines[i][a:b]), []).append((i, a, b))
    gone = {i: set() for i in texts}
    for key, at in places.items():
        if sum(len(x.split(" ")) for x in key) >= least:
            for i, a, b in at[1:]:
                gone[i] |= {k for k, _ in lines[i][a:b]}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_line_runs(docs):
    pick = random.Random(4)
    pool = [" ".join(pick.choices("abcdef", k=pick.randint(1, 6))) for _ in range(12)] + ["", "  "]
    texts = {i: "\n".join(pick.choices(pool, k=pick.randint(0, 14))) for i in range(40)}
    found = linededup.dedup_lines(docs(list(texts.items())), min_words=9)
    assert {r.doc_id: r.text for r in found.collect()} == brute_line_runs(texts, 9)


def test_line_runs_of_odd_rows(docs):
    rows = ODD + [(20, LONG), (None, LONG)]
    found = linededup.dedup_lines(docs(rows), prefix="__")
    got = [(r.doc_id, r.text) for r in found.collect()]
    # The null id is first, so its copy stays and those of 6 and 20 go.
    want = [(i, "" if t == LONG and i is not None else t) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and "lines_before" in found.columns
    assert linededup.dedup_lines(docs(ODD).limit(0)).count() == 0


def brute_groups(rows, percent, k):
    hashes = WordHashes()
    sets = {i: set(neardup.shingle_set(t, hashes, k).tolist()) for i, t in rows if i is not None}
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = {x: a if y == b else y for x, y in top.items()}
    return {i: (len(sets[i]), top[i], top[i] == i) for i in sets}


def test_near_duplicates(docs, monkeypatch):
    monkeypatch.setattr(neardup, "OPEN_PAIRS", 20)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SPLIT", 10)
    pick = random.Random(6)
    base = [f"w{pick.randint(0, 400)}" for _ in range(160)]
    rows = [(i, t) for i, t in ODD if i != 8] + [(8, "repeated row of five words")] * 2
    for i in range(100, 220):  # copies whose similarity to each other lies around the threshold
        words = list(base)
        for k in pick.sample(range(160), pick.randint(0, 7)):
            words[k] = f"x{pick.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[20 + i][1]) for i in range(5)]
    found = neardup.near_duplicates(docs(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect() if r.doc_id is not None}
    assert got == brute_groups(rows, 85, 3) and found.count() == len(rows)
    assert all(r.kept for r in found.filter("doc_id IS NULL").collect())
    assert neardup.near_duplicates(docs(ODD).limit(0)).count() == 0


def test_an_id_with_two_texts_is_linked_through_both(docs):
    base, other = ([f"{p}{k}" for k in range(60)] for p in "wv")
    near = [*other, "more"]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (9, " ".join(other)), (12, " ".join(near)), (7, " ".join([*base, "y"])), (8, "alone " * 9)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == {5: 5, 9: 5, 12: 5, 7: 5, 8: 8}


def test_flags_miss_no_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    wanted = spark.createDataFrame([(k,) for k in range(0, 9000, 7)] + [(None,)], "w long")
    flagged = flag_among(rows, F.col("k"), wanted, F.col("w"), "maybe").collect()
    assert len(flagged) == 5000 and {r.k for r in flagged if r.maybe} == {None, *range(7, 5000, 7)}
    assert flag_among(rows, F.col("k"), wanted.limit(0), F.col("w"), "maybe").filter("maybe").count() == 0


def test_alignment():
    pick = random.Random(1)
    for _ in range(100):
        d = np.array(pick.choices(range(6), k=pick.randint(1, 40)))
        q = np.array(pick.choices(range(6), k=pick.randint(1, 15)))
        h = np.zeros((len(q) + 1, len(d) + 1), int)
        for i in range(1, len(q) + 1):
            for j in range(1, len(d) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == d[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(d, q)[0] == h.max()


@pytest.mark.parametrize("bound", [10, decontaminate.BLOCK_WORDS])
def test_contaminated(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", bound)
    words = [f"q{k}" for k in range(40)]
    edited = list(words)
    edited[7], edited[21] = "other", "changed"
    del edited[30]
    rows = ODD + [(30, f"{LONG}\n{' '.join(words).upper()}, and on"), (31, "intro " + " ".join(edited)), (32, " ".join(words[:12])), (None, " ".join(words))]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (None, "a b c d"), (3, "no id")], "item_id long, text string")
    found = decontaminate.contaminated(docs(rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(30, 1), (31, 1), (None, 1)}
    assert next(r.score for r in found if r.doc_id == 30) == 1.0
    assert decontaminate.without_copies(docs(rows), items).count() == len(rows) - 3
    assert decontaminate.contaminated(docs(ODD), items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(ODD).limit(0), items).count() == 0


def test_every_seed_starts_an_alignment(spark, docs):
    words = [f"q{k}" for k in range(38)]
    edited = [f"x{k}" if k in range(4, 38, 6) else w for k, w in enumerate(words)]
    spread = [f"q{k}" for k in range(100, 160)]
    between = spread[:30] + [f"y{k}" for k in range(40)] + spread[30:]
    rows = [(1, "before " + " ".join(words)), (2, "before " + " ".join(edited)), (3, " ".join(spread)), (4, "some " + " ".join(between))]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(spread))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in decontaminate.contaminated(docs(rows), items).collect()}
    assert found == {(1, 1): (1.0, 1, 39), (2, 1): (58 / 76, 1, 39), (3, 2): (1.0, 0, 60), (4, 2): (80 / 120, 1, 101)}


@pytest.mark.parametrize("spots", [7, decontaminate.SPOTS])
def test_contaminated_against_all_pairs(spark, docs, monkeypatch, spots):
    monkeypatch.setattr(decontaminate, "SPOTS", spots)
    pick = random.Random(11)
    common, rare = [f"c{k}" for k in range(8)], [f"r{k}" for k in range(60)]
    items = [(k, [pick.choice(common if pick.random() < 0.5 else rare) for _ in range(pick.randint(3, 25))]) for k in range(25)]
    rows = []
    for k in range(120):
        words = [pick.choice(common + rare) for _ in range(pick.randint(0, 40))]
        for _ in range(pick.randint(0, 2)):
            copy = [pick.choice(common) if pick.random() < 0.15 else w for w in pick.choice(items)[1] if pick.random() > 0.1]
            words += copy + [pick.choice(common) for _ in range(pick.randint(0, 20))]
        rows.append((k, words))
    hashes, expected = WordHashes(), {}
    for i, words in rows:
        for j, item in items:
            grams = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
            if grams & {tuple(item[k : k + 3]) for k in range(len(item) - 2)}:
                score = decontaminate.align(hashes.of(words), hashes.of(item))[0] / (2 * len(item))
                if score >= 0.6:
                    expected[i, j] = score
    frame = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    got = decontaminate.contaminated(docs([(i, " ".join(w)) for i, w in rows]), frame).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == expected
    assert len(expected) > 60 and len(got) == len(expected)


def test_a_phrase_of_many_items_makes_no_pairs():
    hashes, phrase = WordHashes(), "which of the following".split()
    items = [hashes.of(phrase + [f"i{k}w{j}" for j in range(16)]) for k in range(500)]
    texts = [hashes.of([f"d{k}" for k in range(i)] + phrase + [f"t{i}w{j}" for j in range(40)]) for i in range(2000)]
    counts = {int(w): len(texts) for w in hashes.of(phrase)}
    block = decontaminate.ItemBlock(list(range(500)), items, counts, 0.6, 3)
    assert not [c for t in texts for c in block.candidates(t)]
    assert [k for k, _ in block.candidates(np.concatenate([texts[0], items[7]]))] == [7]


def test_windows_hold_every_copy():
    pick = random.Random(3)
    for _ in range(300):
        item = np.array([pick.randint(0, 12) for _ in range(pick.randint(3, 14))])
        doc = np.array([pick.choice([*item, 50, 51]) for _ in range(pick.randint(3, 60))])
        at = [i - j for i in range(len(doc) - 1) for j in range(len(item) - 1) if (doc[i : i + 2] == item[j : j + 2]).all()]
        best = decontaminate.align(doc, item)[0]
        parts = decontaminate.windows(doc, item, [(a, a) for a in at], 0.6)
        got = max((decontaminate.align(doc[a:b], item)[0] for a, b in parts), default=0)
        assert got == best or best < 1.2 * len(item) or (len(item) < 6 and not parts)


def test_languages(spark, docs):
    english, german = "the thing with this other mother that", "der und das nicht mit einer zwischen"
    taught = [(english, "en"), (german, "de"), ("мама мыла раму", "ru"), (None, "en"), ("x y", None)] * 20
    model = language.fit_languages(spark.createDataFrame(taught, "text string, lang string"))
    mixed = " ".join([english] * 3 + [german])
    labels = language.Labeller(model).label([english, german, mixed, "мыла", "12 ..", "", LONG])
    assert [x[0] for x in labels[:6]] == ["en", "de", "en", "ru", "und", "und"]
    assert [s["lang"] for s in labels[2][2]] == ["en", "de"]
    from pyspark.sql import functions as F

    got = docs(ODD).select("doc_id", language.identify(F.col("text"), model).alias("f")).collect()
    assert all(0 <= r.f.score <= 1 for r in got) and {r.f.lang for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    none = language.fit_languages(docs([(1, None)]).select("text", "lang"))
    assert {r.f.lang for r in docs(ODD).select(language.identify(F.col("text"), none).alias("f")).collect()} == {"und"}


def test_classifiers_without_labels(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 5, 5)], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(docs(ODD), labels) is None
    assert {r[0] for r in docs(ODD).select(quality.quality_score(F.col("text"), None)).collect()} == {0.5}
    model = toxicity.fit_toxicity(docs(ODD), labels)
    assert {r.score for r in toxicity.score_toxicity(docs(ODD), model).collect()} == {0.0}


def test_classifiers_learn(spark, docs):
    from pyspark.sql import functions as F

    pick = random.Random(8)
    texts = []
    for i in range(600):
        words = [f"w{pick.randint(0, 300)}" for _ in range(pick.randint(20, 60))]
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words[:2]] * 20
        elif i % 3 == 1:
            words[3] = pick.choice(["scumbag", "loserish"])
        texts.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 1)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    good = quality.fit_quality(docs(texts), labels)
    scores = docs(texts + ODD).select("doc_id", quality.quality_score(F.col("text"), good).alias("score")).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in scores if r.doc_id and r.doc_id > 20 and r.doc_id % 2]) > 0.97
    found = toxicity.score_toxicity(docs(texts + ODD), toxicity.fit_toxicity(docs(texts), labels)).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 1) for r in found if r.doc_id and r.doc_id > 20 and r.doc_id % 2]) > 0.97
    assert len(found) == len(scores) == 612 and all(0 <= r.score <= 1 for r in [*found, *scores])


def test_toxicity_of_few_rows(spark, docs):
    pick = random.Random(5)
    texts = []
    for i in range(240):
        words = [f"w{pick.randint(0, 200)}" for _ in range(pick.randint(20, 40))]
        if i % 10 == 1:
            words[3:3] = ["you", "scumbag"]
        texts.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(120)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs(texts + ODD), toxicity.fit_toxicity(docs(texts), labels)).collect()
    assert {r.doc_id for r in found if r.doc_id is not None and r.doc_id >= 120 and r.score >= 0.7} == set(range(121, 240, 10))
    # One toxic text shows nothing in common, no toxic text nothing at all.
    for most in (10, 1):
        model = toxicity.fit_toxicity(docs(texts), labels.filter(f"doc_id < {most}"))
        assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs(ODD), model).collect())


def test_class_sample_keeps_the_rarer_class(spark):
    labels = spark.createDataFrame([(i, int(i % 500 == 0)) for i in range(20_000)], "doc_id long, toxic int")
    got = {r.label: r for r in sample.class_sample(labels, "toxic", 1000).groupBy("label").agg({"*": "count", "weight": "sum"}).collect()}
    assert got[1]["count(1)"] == 40 and 700 < got[0]["count(1)"] < 1150
    assert got[1]["sum(weight)"] == 40 and abs(got[0]["sum(weight)"] / 19_960 - 1) < 0.15


def test_nearest(spark):
    random_ = np.random.default_rng(9)
    x = random_.normal(size=(400, 12)) * random_.uniform(0.5, 2, size=(400, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[20].tolist(), 0) for i in range(30)]
    bad = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] * 12, 0), (2060, [1.0, None] * 6, 0), (2080, [1.0] * 3, 0), (None, x[0].tolist(), 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    found = neighbours.nearest(frame, "vec_id % 20 = 0").collect()
    vectors = {i: np.array(v) for i, v, _ in rows}
    queries = [i for i in vectors if i % 20 == 0]
    hit = 0
    for q in queries:
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        scores = sorted(((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:20]
        assert [r.rank for r in got] == list(range(1, 21)) and all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in got)
        hit += len({i for _, i in scores} & {r.vec_id for r in got})
    assert hit >= 0.9 * 20 * len(queries) and {r.query_id for r in found} == set(queries)
    assert neighbours.nearest(frame.limit(0), "true").count() == 0


def test_descent_finds_what_the_start_lacks(spark):
    pick = np.random.default_rng(12)
    x = pick.normal(size=(2000, 10)) @ pick.normal(size=(10, 24)) + 0.3 * pick.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = x.astype(np.float16)
    nodes = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(half)], "id long, half binary").repartition(4)
    sims = half.astype(np.float32) @ half.astype(np.float32).T
    np.fill_diagonal(sims, -1)
    true = [set(r) for r in np.argsort(-sims, axis=1)[:, :20].tolist()]

    def recall(graph):
        return sum(len(true[r.id] & set(r.near)) for r in graph.collect()) / (20 * 2000)

    start = neighbours._merged(neighbours.start_lists(nodes, 2000, 2, 16, 24), 24)
    assert recall(start) < 0.7 and recall(neighbours.build_graph(nodes, tables=2, leaf=16, degree=24)) >= 0.9


def test_nodes_alone_in_all_tables_are_linked(spark):
    pick = np.random.default_rng(2)
    x = pick.normal(size=(300, 16))
    nodes = spark.createDataFrame([(k, (v / np.linalg.norm(v)).astype(np.float16).tobytes()) for k, v in enumerate(x)], "id long, half binary")
    start = neighbours._merged(neighbours.start_lists(nodes, 300, 1, 2, 8), 8)
    graph = neighbours.build_graph(nodes, tables=1, leaf=2, degree=8).collect()
    assert start.count() < 300 and {r.id for r in graph} == set(range(300)) and all(len(r.near) == 8 for r in graph)


def test_old_links_are_not_compared_again(spark):
    eye = np.eye(6, dtype=np.float16)
    nodes = spark.createDataFrame([(i, eye[i % 3].tobytes()) for i in range(6)], "id long, half binary")
    schema = neighbours._LISTS + ", fresh array<boolean>"
    for fresh, pairs in (([False, False], set()), ([True, False], {(1, 2), (2, 1)})):
        graph = spark.createDataFrame([(0, [1, 2], [0.0, 0.0], fresh)], schema)
        found = neighbours.descend(graph, nodes, 9, 8).collect()
        assert {(r.id, n) for r in found for n in r.near} == pairs


def test_vectors_of_an_odd_length_take_no_part(spark):
    pick = np.random.default_rng(7)
    rows = [(k, pick.normal(size=4).tolist()) for k in range(50)] + [(100, [1.0] * 9), (101, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, "vec_id % 10 = 0", k=3).collect()
    assert {r.query_id for r in got} == {0, 10, 20, 30, 40} and len(got) == 15


def test_proposals_cut_in_between_give_the_same_lists(spark, monkeypatch):
    pick = np.random.default_rng(8)
    x = pick.normal(size=(400, 6))
    half = [(k, (v / np.linalg.norm(v)).astype(np.float16).tobytes()) for k, v in enumerate(x)]
    nodes = spark.createDataFrame(half, "id long, half binary").repartition(4)
    graph = neighbours._merged(neighbours.start_lists(nodes, 400, 2, 20, 8), 8)
    lists = []
    for held in (2_000_000, 300):
        monkeypatch.setattr(neighbours, "HELD_PROPOSALS", held)
        found = neighbours._merged(graph.union(neighbours.descend(graph, nodes, 8, 8)), 8)
        lists.append(sorted((r.id, tuple(r.near)) for r in found.collect()))
    assert lists[0] == lists[1] and len(lists[0]) == 400


def test_a_walk_that_does_not_end_is_an_error(spark, monkeypatch):
    pick = np.random.default_rng(9)
    rows = [(k, pick.normal(size=8).tolist()) for k in range(300)]
    monkeypatch.setattr(neighbours, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="open members"):
        neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 50 = 0", k=5)


def test_links_of_a_hub_are_whole(spark):
    graph = spark.createDataFrame([(i, [1000, 1001], [1.0, 1.0]) for i in range(300)], "id long, near array<long>, sims array<float>")
    links = neighbours._links(graph, 32).collect()
    assert {m.id for r in links if r.centre == 1000 for m in r.members} == set(range(300))
    assert max(len(r.members) for r in links) < 100 and len({(r.centre, r.part) for r in links}) == len(links)


def test_rounds_go_on_until_links_settle(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, np.eye(6, dtype=np.float16)[i].tobytes()) for i in range(6)], "id long, half binary")
    rounds = []

    def improve(graph, *_):
        rounds.append(len(rounds))
        better = [(i, [100 + len(rounds)], [float(len(rounds))]) for i in range(6)] if len(rounds) < 8 else []
        return spark.createDataFrame(better, neighbours._LISTS)

    monkeypatch.setattr(neighbours, "descend", improve)
    graph = neighbours.build_graph(nodes, tables=1, degree=3).collect()
    assert len(rounds) == 8 and {tuple(r.near) for r in graph} == {(107, 106, 105)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_pipeline_stages(spark, docs):
    for rows in (ODD, []):
        for name, stage in corpus_pipeline.STAGES:
            frame = docs(ODD) if rows else docs(ODD).limit(0)
            found = stage(spark, frame, SF)
            if name != "packing":
                assert found.columns == frame.columns, name
            assert found.count() <= 4 * len(rows) + 100
    one = corpus_pipeline.keep_one_of_each_group(spark, docs(ODD), SF)
    assert {r.doc_id for r in one.collect()} == {i for i, _ in ODD} - {7}
    assert corpus_pipeline.run(spark, SF).count() > 0
