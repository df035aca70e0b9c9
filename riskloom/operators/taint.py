"""Per-file taint for SQL injection (span profile), as array expressions.

Nothing here shuffles: a file's tainted variables and its query calls are both
derived from the one text cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.rules import SPAN_SQL_INJECTION, SUPERGLOBAL, TAINT_SANITIZERS, has_token

# First assignment of a line, and how far a call without a
# semicolon after it is followed.
ASSIGNMENT = r"(?iU)\$([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.+?)\s*;"
OPEN_CALL_CHARS = 600

# The shortest call, and more than any display of a match takes after white space is collapsed.
CALL_CHARS = len("->query(")
SHOWN_CHARS = 200


def is_tainting(rhs: Column) -> Column:
    """A request value that no sanitizer touches."""
    return F.rlike(rhs, F.lit(SUPERGLOBAL)) & ~has_token(rhs, TAINT_SANITIZERS)


def tainted_vars(text: Column) -> Column:
    """Distinct variables of a text assigned from request values."""
    # Byte searches first: only lines with a request value can taint.
    lines = F.filter(tx.split_lines(text), lambda line: F.contains(line, F.lit("$_")))
    names = F.transform(
        lines,
        lambda line: F.when(
            is_tainting(F.regexp_extract(line, ASSIGNMENT, 2)), F.regexp_extract(line, ASSIGNMENT, 1)
        ),
    )
    return F.when(
        F.contains(text, F.lit("$_")), F.array_distinct(F.array_compact(names))
    ).otherwise(F.array().cast("array<string>"))


def query_calls(text: Column) -> Column:
    """``array<struct<line, snippet>>``: every query call up to its semicolon."""
    return tx.let(
        tx.mark_matches(text, SPAN_SQL_INJECTION.text_pattern),
        lambda marked: F.zip_with(
            tx.marked_lines(marked),
            _per_call(marked, _closed_snippets, _open_snippets),
            lambda line, snippet: F.struct(line.alias("line"), snippet.alias("snippet")),
        ),
    )


def _per_call(marked: Column, closed, unclosed) -> Column:
    """One string for each mark: ``closed(parts)`` in a statement that a semicolon ends, ``unclosed(parts)`` in the last.

    ``parts`` are a statement cut at its marks, the first of them before any call.
    """
    return F.flatten(
        tx.let(
            F.regexp_count(marked, F.lit(";")),
            lambda last: F.transform(
                F.split(marked, ";", -1),
                lambda statement, index: F.when(
                    tx.has_mark(statement),
                    tx.let(tx.marked_parts(statement), lambda parts: F.when(index == last, unclosed(parts)).otherwise(closed(parts))),
                ).otherwise(F.array().cast("array<string>")),
            ),
        )
    )


def _from_each(parts: Column, most: int | None = None) -> Column:
    """What follows each mark, over at most ``most`` parts."""
    count = F.size(parts) if most is None else F.lit(most)
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, count), ""))


def _closed_snippets(parts: Column) -> Column:
    return _from_each(parts)


def _open_snippets(parts: Column) -> Column:
    """At most ``OPEN_CALL_CHARS`` from each call, put together from as few parts as can hold them."""
    cut = F.transform(parts, lambda part: F.substring(part, 1, OPEN_CALL_CHARS))
    return tx.let(
        cut,
        lambda cut: F.transform(
            _from_each(cut, -(-OPEN_CALL_CHARS // CALL_CHARS)), lambda tail: F.substring(tail, 1, OPEN_CALL_CHARS)
        ),
    )


def _is_dirty(snippet: Column, tainted: Column) -> Column:
    """A request value, or ``$name`` of a tainted variable as a plain substring."""
    return F.rlike(snippet, F.lit(SUPERGLOBAL)) | F.exists(
        tainted, lambda name: F.contains(snippet, F.concat(F.lit("$"), name))
    )


def tainted_calls(text: Column) -> Column:
    """The query calls that use a request value or a tainted variable, with their whole snippets."""
    return tx.let(
        tainted_vars(text),
        lambda tainted: F.filter(query_calls(text), lambda call: _is_dirty(call["snippet"], tainted)),
    )


def sql_injection(text: Column) -> Column:
    """``array<struct<line, match>>`` of the tainted calls, matches long enough to be shown.

    Snippets of one statement lie within each other.  So a call is tainted if the last tainted part lies not before
    it, and of each snippet only as many shortened parts are put together as are shown: the work grows with the text,
    however many calls a statement has.
    """

    def closed(parts: Column, tainted: Column) -> Column:
        # No request value and no variable reaches over a mark, as a call begins with an arrow.
        dirty = F.transform(parts, lambda part, n: F.when((n > 0) & _is_dirty(part, tainted), n).otherwise(F.lit(-1)))
        short = F.transform(parts, lambda part: F.substring(F.regexp_replace(part, tx.SPACE_RUN, " "), 1, SHOWN_CHARS))
        shown = tx.let(short, lambda short: _from_each(short, -(-SHOWN_CHARS // CALL_CHARS)))
        return tx.let(
            F.array_max(dirty),
            lambda last: F.transform(shown, lambda shown, n: F.when(n + 1 <= last, shown)),
        )

    def unclosed(parts: Column, tainted: Column) -> Column:
        return F.transform(_open_snippets(parts), lambda snippet: F.when(_is_dirty(snippet, tainted), snippet))

    calls = tx.let(
        F.struct(
            tainted_vars(text).alias("tainted"), tx.mark_matches(text, SPAN_SQL_INJECTION.text_pattern).alias("marked")
        ),
        lambda found: F.zip_with(
            tx.marked_lines(found["marked"]),
            _per_call(
                found["marked"], lambda parts: closed(parts, found["tainted"]), lambda parts: unclosed(parts, found["tainted"])
            ),
            lambda line, match: F.struct(line.alias("line"), match.alias("match")),
        ),
    )
    return F.filter(calls, lambda call: call["match"].isNotNull())


def tainted_vars_table(texts: DataFrame) -> DataFrame:
    """``(path, var)``, one row per tainted variable of a file."""
    return texts.select("path", F.explode(tainted_vars(F.col("text"))).alias("var"))


def query_calls_table(texts: DataFrame) -> DataFrame:
    """``(path, line, snippet)``, one row per query call."""
    called = texts.filter(F.rlike("text", F.lit(SPAN_SQL_INJECTION.text_pattern)))
    return called.select("path", F.inline(query_calls(F.col("text"))))
