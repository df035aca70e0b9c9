"""Line dedup: later copies of repeated line runs are deleted; DataFrame functions only.

A text is the sequence of its lines that are not blank.  Its suffixes are named by distributed prefix doubling: the
name of a suffix at depth 1 is the first place in the corpus of its first line, and two neighbouring blocks of depth
``d`` give the name at depth ``2d``: the first place of that pair.  So suffixes with equal names at a depth are one
longest-common-prefix interval of the suffix array, and the name is the interval's first copy.  Names of any depth
between come from two overlapping blocks.

A run is deleted where it stands for the second time or later and has at least ``min_words`` words.  A maximal run is
the union of its shortest stretches of that many words, those that begin at each line and those that end at each line,
and each of these is repeated itself; so it is enough to look at these stretches, and the doubling ends at the depth
of the longest (at most ``min_words`` lines), however long the runs are.  Neighbouring deleted stretches form the
maximal run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import flag_among
from riskloom.session import materialize

#: Least words of a repeated run that is deleted.
MIN_WORDS = 50

_NULL_ID = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key columns that order documents: the id, null first, then a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text")
    )


def _place() -> Column:
    return F.struct("doc", "tie", "pos")


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, tie, pos, at, words, h1, h2``: the lines that are not blank, by number among them and among all lines."""
    pieces = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    kept = F.filter(pieces, lambda s: s["line"] != "")
    exploded = _keyed(docs, id_col, text_col).select("doc", "tie", F.posexplode(kept).alias("pos", "s"))
    line = F.col("s.line")
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return exploded.select(
        "doc",
        "tie",
        "pos",
        F.col("s.at").alias("at"),
        words.alias("words"),
        F.xxhash64(line).alias("h1"),
        F.xxhash64(F.lit(1), line).alias("h2"),
    )


def _first_places(blocks: DataFrame, *key: str) -> DataFrame:
    """First place of each key that occurs more than once; aggregated before the shuffle, then written."""
    seen = blocks.groupBy(*key).agg(F.count("*").alias("n"), F.min(_place()).alias("name"))
    return materialize(seen.filter("n > 1").select(*key, "name"))


def _long_enough(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of neighbouring repeated lines that have the words for a run."""
    by_doc = Window.partitionBy("doc", "tie").orderBy("pos")
    island = Window.partitionBy("doc", "tie", "island")
    marked = lines.withColumn("island", F.col("pos") - F.row_number().over(by_doc))
    marked = marked.withColumn("total", F.sum("words").over(island)).filter(F.col("total") >= min_words)
    before = island.orderBy("pos")
    return marked.select(
        "doc", "tie", "pos", "at", "words", "island", F.sum("words").over(before).alias("until"), "name"
    )


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """``doc, tie, pos, size``: the shortest stretches of enough words from each line on, and up to each line.

    Lines have at least one word, so the running totals of a stretch are distinct.  A stretch from a line on takes the
    lines before which it has not yet enough words; one up to a line, those after which it has not.
    """
    island = Window.partitionBy("doc", "tie", "island")
    near = lines.withColumn("before", F.col("until") - F.col("words")).withColumn("all", F.max("until").over(island))
    ahead = F.count("*").over(island.orderBy("before").rangeBetween(Window.currentRow, min_words - 1))
    behind = F.count("*").over(island.orderBy("until").rangeBetween(1 - min_words, Window.currentRow))
    near = near.withColumn("ahead", ahead).withColumn("behind", behind)
    forward = near.filter(F.col("all") - F.col("before") >= min_words).select("doc", "tie", "pos", F.col("ahead").alias("size"))
    backward = near.filter(F.col("until") >= min_words).select(
        "doc", "tie", (F.col("pos") - F.col("behind") + 1).cast("int").alias("pos"), F.col("behind").alias("size")
    )
    return forward.union(backward).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, tie, at``: the lines to delete, each once, by their number among all lines of the text."""
    lines = materialize(numbered_lines(docs, id_col, text_col))
    firsts = _first_places(lines, "h1", "h2")
    named = lines.join(firsts, ["h1", "h2"]).dropDuplicates(["doc", "tie", "pos"])
    active = materialize(_long_enough(named, min_words))
    stretches = materialize(_stretches(active, min_words))
    longest = stretches.agg(F.max("size")).first()[0] or 0
    depth, names = 1, active.select("doc", "tie", "pos", "name")
    copies = []
    while depth <= longest:
        # Stretches of depth to 2 * depth - 1 lines: two blocks that overlap.
        now = stretches.filter((F.col("size") >= depth) & (F.col("size") < 2 * depth))
        other = names.select("doc", "tie", F.col("pos").alias("tail"), F.col("name").alias("tail_name"))
        ends = now.withColumn("tail", F.col("pos") + F.col("size") - depth)
        pairs = ends.join(names, ["doc", "tie", "pos"]).join(other, ["doc", "tie", "tail"])
        pairs = materialize(pairs.select("doc", "tie", "pos", "size", F.col("name").alias("head_name"), "tail_name"))
        key = ["size", "head_name", "tail_name"]
        later = pairs.join(_first_places(pairs, *key), key).filter(_place() > F.col("name"))
        copies.append(later.select("doc", "tie", "pos", "size"))
        if 2 * depth <= longest:
            step = names.join(
                names.select("doc", "tie", (F.col("pos") - depth).alias("pos"), F.col("name").alias("next")),
                ["doc", "tie", "pos"],
            )
            step = materialize(step.select("doc", "tie", "pos", F.col("name").alias("head"), "next"))
            deeper = step.join(_first_places(step, "head", "next"), ["head", "next"])
            names = materialize(deeper.select("doc", "tie", "pos", "name"))
        depth *= 2
    if not copies:
        return active.select("doc", "tie", "at").limit(0)
    found = copies[0]
    for c in copies[1:]:
        found = found.union(c)
    covered = found.select(
        "doc", "tie", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size").cast("int") - 1)).alias("pos")
    ).distinct()
    return covered.join(active.select("doc", "tie", "pos", "at"), ["doc", "tie", "pos"]).select("doc", "tie", "at")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, prefix: str = ""
) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated runs cut from the text, and three counts.

    Added: ``lines_before``, ``lines_deleted``, ``words_deleted``, after ``prefix``, replacing columns of these names.  Copies are later
    in the order of ids (null first; equal ids by a hash of their texts); rows equal in id and text count as one
    document and are treated alike.  Lines are compared without spaces around them; blank lines are neither compared
    nor deleted.  A null text stays null, an empty one empty.  No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = materialize(repeated_lines(docs, id_col, text_col, min_words))
    touched = gone.groupBy("doc", "tie").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    mask_at = "__gone"
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), F.xxhash64(text)]
    # One flag for each line, made before the join so that no line searches the list.
    touched = materialize(
        touched.select(
            F.col("doc").alias("__doc"),
            F.col("tie").alias("__tie"),
            F.flatten(
                F.transform(
                    "gone",
                    lambda x, i: F.concat(
                        F.array_repeat(F.lit(False), x - F.when(i == 0, -1).otherwise(F.get("gone", i - 1)) - 1),
                        F.array(F.lit(True)),
                    ),
                )
            ).alias(mask_at),
        )
    )
    added = [prefix + name for name in ("lines_before", "lines_deleted", "words_deleted")]
    columns = [c for c in docs.columns if c not in added]
    # Most documents have nothing to delete; those that surely have not stay where they are.
    flagged = flag_among(docs.select(*columns, keys[0].alias("__id"), keys[1].alias("__hash")), F.col("__hash"), touched, F.col("__tie"), "__maybe")
    moved = flagged.filter("__maybe").join(
        touched, (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__tie")), "left"
    )
    kept_in_place = flagged.filter("NOT __maybe")
    text_of = F.col(text_col).cast("string")
    # Nothing is cut from these, so no text is taken apart: line breaks are counted in bytes.
    breaks = F.octet_length(text_of) - F.octet_length(F.replace(text_of, F.lit("\n"), F.lit("")))
    whole = kept_in_place.select(
        *columns,
        F.when(F.col(text_col).isNull(), 0).otherwise(breaks + 1).alias(added[0]),
        F.lit(0).alias(added[1]),
        F.lit(0).alias(added[2]),
    )
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(mask_at), i), F.lit(False))), "\n")
    new = F.when(F.col(mask_at).isNull(), F.col(text_col)).otherwise(kept)

    def words(c: Column) -> Column:
        return F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))

    cut = moved.select(*columns, mask_at).withColumn("__new", new)
    changed = cut.select(
        *[F.col("__new").alias(c) if c == text_col else F.col(c) for c in columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(added[0]),
        F.size(F.filter(F.coalesce(F.col(mask_at), F.array(F.lit(False))), lambda x: x)).alias(added[1]),
        F.when(F.col(mask_at).isNull(), 0).otherwise(words(F.col(text_col)) - words(F.col("__new"))).alias(added[2]),
    )
    return changed.unionAll(whole)
