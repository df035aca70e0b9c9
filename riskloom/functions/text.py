"""Text expressions: decoding, line splitting, match positions, display strings.

All of it is built-in Catalyst expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line once CR and CRLF have become LF.
LINE_BREAKS = r"\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# White space that stays on one line.
INLINE_SPACE = rf"[\s&&[^\r{LINE_BREAKS}]]"

# Runs of white space that are shown as one blank.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

_MARK = "\u0001"
_UNMARK = "\u0002"
_ELLIPSIS = "…"


def decode_text(content: Column, policy: str) -> Column:
    """Bytes to text.  ``strict`` gives NULL for a file that is not valid UTF-8."""
    raw = content.cast("string")
    if policy == "strict":
        return F.try_validate_utf8(raw)
    repaired = F.make_valid_utf8(raw)
    if policy == "replace":
        return repaired
    if policy == "ignore":
        # Bad bytes surface as U+FFFD; valid texts keep theirs.
        return F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(repaired, "\ufffd", ""))
    raise ValueError(f"unknown decode policy {policy!r}")


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR to LF; texts without a CR pass untouched."""
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines without their terminators; a final terminator opens no extra line.

    Splitting at the line feed alone takes a fast path in the JVM; the full
    class of line breaks is used only for texts that hold one of the others.
    """
    any_break = F.split(F.regexp_replace(text, rf"[{LINE_BREAKS}]\z", ""), rf"[{LINE_BREAKS}]", -1)
    cut = F.when(
        F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(_has_rare_break(text), any_break)
        .otherwise(F.split(cut, "\n", -1))
    )


def _has_rare_break(text: Column) -> Column:
    found = F.lit(False)
    for char in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
        found = found | F.contains(text, F.lit(char))
    return found


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(strip(text), SPACE_RUN, " ")


def shorten(text: Column, limit: int = 160) -> Column:
    """Collapse white space, then cut to ``limit`` characters including the ellipsis."""
    flat = collapse_spaces(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit(_ELLIPSIS))
    )


def markdown_cell(text: Column, limit: int = 80) -> Column:
    """Table cell: one line, pipes escaped, cut after escaping.

    The ellipsis depends on the length before escaping.
    """
    flat = strip(F.array_join(split_lines(normalize_newlines(text)), " "))
    cut = F.substring(F.replace(flat, F.lit("|"), F.lit("\\|")), 1, limit)
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit(_ELLIPSIS))).otherwise(cut)


def quoted(text: Column) -> Column:
    """A string literal: single quotes unless only single quotes occur inside."""
    escaped = text
    for char, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    has_single = F.contains(text, F.lit("'"))
    has_double = F.contains(text, F.lit('"'))
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mark_matches(text: Column, pattern: str) -> Column:
    """Put a control mark in front of every match of ``pattern``."""
    # Marks that are already in the text are rare and lose their meaning.
    unmarked = F.when(has_mark(text), F.translate(text, _MARK, _UNMARK)).otherwise(text)
    return F.regexp_replace(unmarked, pattern, _MARK + "$0")


def marked_lines(marked: Column) -> Column:
    """1-based line of every mark, in text order, in one linear pass.

    Everything but marks and newlines is dropped; each remaining line then
    holds as many marks as matches start on it.
    """
    skeleton = F.regexp_replace(marked, rf"[^\n{_MARK}]+", "")
    per_line = F.transform(
        F.split(skeleton, "\n", -1),
        lambda marks, index: F.array_repeat((index + 1).cast("int"), F.length(marks)),
    )
    return F.flatten(per_line)


def match_lines(text: Column, pattern: str) -> Column:
    return marked_lines(mark_matches(text, pattern))


def marked_parts(marked: Column) -> Column:
    """The text cut at the marks: first what precedes them, then one part per mark."""
    return F.split(marked, _MARK, -1)


def has_mark(marked: Column) -> Column:
    return F.contains(marked, F.lit(_MARK))


def touched_lines_hold(text: Column, lines: Column, matches: Column, test) -> Column:
    """For each match, which starts on the line of the same place in ``lines``: does a line it touches pass ``test``?

    Every line of the text is tested once; a match then looks at its interval of lines.
    """
    return let(
        F.transform(F.split(text, "\n", -1), test),
        lambda found: F.zip_with(
            lines,
            matches,
            lambda line, match: F.exists(
                F.slice(found, line, F.length(match) - F.length(F.replace(match, F.lit("\n"), F.lit(""))) + 1), lambda hit: hit
            ),
        ),
    )


def line_of_tail(text: Column, tail: Column) -> Column:
    """1-based line on which ``tail``, a suffix of ``text``, starts."""
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")
