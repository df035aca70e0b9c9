"""One query for each operator over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    alignment,
    bitplanes,
    decontaminate,
    hardneg,
    language,
    linededup,
    neardup,
    neighbours,
    packing,
    quality,
    tokencount,
    toxicity,
    warc,
)
from riskloom.llm.common import in_fold, table
from riskloom.session import run_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as byte planes, read the planes back."""
    folder = run_dir(spark, "token-ids")
    bitplanes.write_ids(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return bitplanes.document_digests(spark, folder)


@query
def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens; all their tokens bear loss."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def scored(score: DataFrame, folds: int, held: int, threshold: float = 0.7) -> DataFrame:
    return score.select(
        "doc_id",
        in_fold(F.col("doc_id"), folds, held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.filter(~in_fold(F.col("doc_id"), 3, 1))
    model = toxicity.fit_toxicity(docs, seen)
    return scored(toxicity.score_toxicity(docs, model), 3, 1)


@query
def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~in_fold(F.col("doc_id"), 4, 2)))
    return scored(docs.select("doc_id", quality.quality_score(F.col("text"), model).alias("score")), 4, 2)


@query
def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs.filter(~held))
    found = docs.select("doc_id", held.alias("held_out"), language.identify(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.size("found.spans").alias("n_spans"),
    )


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 85 % of their word trigrams in common."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
  coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.doc_id = d.doc_id
"""


@query
def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "lines_before", "lines_deleted", "words_deleted", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


ORACLES["op3_line_runs"] = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), pieces AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM raw
), lines AS (
  SELECT doc_id, place, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos,
    length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS words
  FROM pieces WHERE trim(line) <> ''
), totals AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS until FROM lines
), texts AS (
  SELECT doc_id, list(line ORDER BY pos) AS arr FROM lines GROUP BY doc_id
), stretches AS (
  SELECT DISTINCT x.doc_id, x.pos AS first_pos, y.pos AS last_pos
  FROM totals x JOIN totals y ON x.doc_id = y.doc_id AND y.pos >= x.pos
  WHERE y.until - (x.until - x.words) >= 50
    AND (y.until - y.words - (x.until - x.words) < 50 OR y.until - x.until < 50)
), keyed AS (
  SELECT s.*, row_number() OVER (
    PARTITION BY array_to_string(arr[first_pos:last_pos], chr(10)) ORDER BY s.doc_id, first_pos) AS copy
  FROM stretches s JOIN texts t ON t.doc_id = s.doc_id
), gone AS (
  SELECT DISTINCT k.doc_id, l.place FROM keyed k
  JOIN lines l ON l.doc_id = k.doc_id AND l.pos BETWEEN first_pos AND last_pos WHERE copy > 1
), rebuilt AS (
  SELECT p.doc_id, count(g.place) AS n,
    coalesce(string_agg(p.line, chr(10) ORDER BY p.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM pieces p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY p.doc_id
)
SELECT raw.doc_id, CAST(len(ls) AS INTEGER) AS lines_before, CAST(n AS INTEGER) AS lines_deleted,
  CAST(len(list_filter(regexp_split_to_array(raw.text, '\s+'), lambda x: x <> ''))
    - len(list_filter(regexp_split_to_array(rebuilt.text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words_deleted,
  md5(rebuilt.text) AS text_md5
FROM raw JOIN rebuilt ON raw.doc_id = rebuilt.doc_id
"""


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items in all documents, edited ones too."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, merge their index runs, read every record back by the index."""
    folder = run_dir(spark, "archives")
    index = warc.merge_runs(warc.write_archives(table(spark, sf_dir, "pages"), folder))
    return warc.read_archives(index, folder).drop("slice", "position")


# Places in the merged index are left out: slices depend on sampled range bounds.
ORACLES["op2_warc_index"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest
"""


@query
def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products for each twentieth vector, against all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte groups and links of two tokenizers' tokens, over whole documents."""
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), TOKENIZER, pieces)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth vector, for its five nearest of the same label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all whole documents by the lower-casing word tokenizer."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
