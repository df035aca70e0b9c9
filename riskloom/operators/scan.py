"""The one-pass content scan: all rules over one read of every file, map-only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.paths import basename, is_custom, is_php
from riskloom.model import FINDING_DDL, Profile, profile_of
from riskloom.operators import taint
from riskloom.operators.rules import (
    ALLOW_MARKERS,
    BLOCK_CALL_TO_END,
    BLOCK_SQL_INJECTION,
    BLOCK_UP_TO_LAST_REQUEST,
    CREDENTIALS,
    LEAK_EXTENSIONS,
    LEAKS,
    SPAN_SQL_INJECTION,
    RuleSpec,
    at_least,
    has_token,
    is_exotic,
    security_rules,
)

_HITS = "array<struct<line:int,match:string>>"
_FINDINGS = "array<struct<scanner:string,line:int,rule:string,severity:string,match:string>>"


def custom_files(files: DataFrame, profile: str | Profile, root: str | None = None) -> DataFrame:
    """Project PHP files of a listing or content table."""
    prof = profile_of(profile)
    return files.filter(is_php(F.col("path"), prof) & is_custom(F.col("path"), prof, root))


# Reasons of skipped files.
UNREADABLE = "unreadable"
NOT_UTF8 = "not valid UTF-8"


def opened(files: DataFrame, profile: str | Profile) -> DataFrame:
    """``(path, text, skipped)`` with the profile's decoding; ``skipped`` is the reason why a text is NULL."""
    prof = profile_of(profile)
    content = F.col("content")
    if files.schema["content"].dataType.typeName() == "binary":
        content = tx.decode_text(content, prof.decode)
    read = files.select("path", F.col("content").isNull().alias("missing"), content.alias("raw"))
    reason = F.when(F.col("missing"), F.lit(UNREADABLE)).when(F.col("raw").isNull(), F.lit(NOT_UTF8))
    return read.select("path", tx.normalize_newlines(F.col("raw")).alias("text"), reason.alias("skipped"))


def decoded(files: DataFrame, profile: str | Profile) -> DataFrame:
    """``(path, text)`` with the profile's decoding, without skipped files."""
    prof = profile_of(profile)
    content = F.col("content")
    if files.schema["content"].dataType.typeName() == "binary":
        content = tx.decode_text(content, prof.decode)
    readable = files.select("path", content.alias("raw")).filter("raw is not null")
    return readable.select("path", tx.normalize_newlines(F.col("raw")).alias("text"))


def skipped_files(files: DataFrame, profile: str | Profile) -> DataFrame:
    """``(path, reason)``: project files that a scan of this profile passes over."""
    found = opened(custom_files(files, profile), profile).filter("skipped is not null")
    return found.select("path", F.col("skipped").alias("reason"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """``(path, line_no, line)``, one row per line."""
    return texts.select(
        "path", F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "line")
    ).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def scan_lines(texts: DataFrame, rules: Iterable[RuleSpec]) -> DataFrame:
    """One finding per (rule, line); the match is the stripped line.

    Each text is lower-cased once as a whole and split alongside, which keeps
    its lines aligned; as a generated column it is not computed again by the
    filter.
    """
    lines = (
        texts.select(
            "path",
            tx.split_lines(F.col("text")).alias("line"),
            tx.split_lines(F.lower("text")).alias("low"),
            is_exotic(F.col("text")).alias("exotic"),
        )
        .select("path", "exotic", F.posexplode(F.arrays_zip("line", "low")).alias("pos", "both"))
        .select("path", (F.col("pos") + 1).alias("line_no"), "both.line", "both.low", "exotic")
    )
    return _scan_prepared(lines, tuple(rules))


def scan_line_rows(lines: DataFrame, rules: Iterable[RuleSpec]) -> DataFrame:
    """``scan_lines`` for rows ``(path, line_no, line)`` that are lines already."""
    line = F.col("line")
    prepared = lines.select(
        "path", "line_no", "line", F.lower(line).alias("low"), is_exotic(line).alias("exotic")
    )
    return _scan_prepared(prepared, tuple(rules))


def _scan_prepared(lines: DataFrame, rules: tuple[RuleSpec, ...]) -> DataFrame:
    line, low, exotic = F.col("line"), F.col("low"), F.col("exotic")
    lines = lines.filter(reduce(lambda a, b: a | b, [r.possible(low, exotic) for r in rules]))
    hits = F.array_compact(
        F.array(*[F.when(r.possible(low, exotic) & r.hits(line), _tag(r)) for r in rules])
    )
    return lines.select("path", "line_no", "line", F.inline(hits)).select(
        "scanner",
        F.col("path").alias("file"),
        F.col("line_no").alias("line"),
        "rule",
        "severity",
        tx.strip(line).alias("match"),
    )


def _tag(rule: RuleSpec) -> Column:
    return F.struct(
        F.lit(rule.scanner).alias("scanner"),
        F.lit(rule.name).alias("rule"),
        F.lit(rule.severity).alias("severity"),
    )


def scan_texts(texts: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile) -> DataFrame:
    """One finding per match over the whole text."""
    return text_rows(texts, rules, profile, F.array().cast(_FINDINGS))


def text_rows(texts: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile, others: Column) -> DataFrame:
    """Findings of whole texts, and what ``others`` (on the columns of ``texts``) adds to them, in one pass."""
    show = tx.shorten if profile_of(profile).name == "span" else tx.strip
    text, low, exotic = F.col("text"), F.col("low"), F.col("exotic")
    prepared = texts.select("path", "text", F.lower(text).alias("low"), is_exotic(text).alias("exotic"), others.alias("others"))
    per_rule = [
        F.when(
            rule.possible(low, exotic) & _has_hit(text, rule),
            _findings(_rule_hits(text, rule), rule),
        ).otherwise(F.array().cast(_FINDINGS))
        for rule in rules
    ]
    # Matches are put in shape after they have become rows, in compiled code.
    return prepared.select("path", F.inline(F.concat(*per_rule, F.col("others")))).select(
        "scanner",
        F.col("path").alias("file"),
        "line",
        "rule",
        "severity",
        F.when(F.col("severity").isNull(), F.col("match")).otherwise(show(F.col("match"))).alias("match"),
    )


def _findings(hits: Column, rule: RuleSpec) -> Column:
    return F.transform(
        hits,
        lambda hit: F.struct(
            F.lit(rule.scanner).alias("scanner"),
            hit["line"].alias("line"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.severity).alias("severity"),
            hit["match"].alias("match"),
        ),
    )


def _has_hit(text: Column, rule: RuleSpec) -> Column:
    if rule is BLOCK_SQL_INJECTION:
        # Its own two steps are linear; the whole pattern is not.
        return F.contains(text, F.lit("$_"))
    return F.rlike(text, F.lit(rule.text_pattern))


def _rule_hits(text: Column, rule: RuleSpec) -> Column:
    if rule is SPAN_SQL_INJECTION:
        return taint.sql_injection(text)
    if rule is BLOCK_SQL_INJECTION:
        return _first_call_to_last_request(text)
    if rule.veto:
        return tx.let(_matches(text, rule.text_pattern), lambda hits: _without_vetoed(text, hits, rule))
    return _matches(text, rule.text_pattern)


def _without_vetoed(text: Column, hits: Column, rule: RuleSpec) -> Column:
    vetoed = tx.touched_lines_hold(text, hits["line"], hits["match"], lambda line: has_token(line, rule.veto))
    kept = F.zip_with(hits, vetoed, lambda hit, no: F.when(~no, hit))
    return F.filter(kept, lambda hit: hit.isNotNull())


def _matches(text: Column, pattern: str) -> Column:
    return F.zip_with(
        tx.match_lines(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda line, match: F.struct(line.alias("line"), match.alias("match")),
    )


def pattern_hits(text: Column, pattern: str) -> Column:
    """``array<struct<line, match>>`` of all matches; no work for texts without one."""
    return F.when(F.rlike(text, F.lit(pattern)), _matches(text, pattern)).otherwise(
        F.array().cast(_HITS)
    )


def _first_call_to_last_request(text: Column) -> Column:
    """The greedy block match, at most one per file, in linear time.

    The text from the first call on is cut at its last request value.  Trying
    the whole pattern at every call would rescan the rest of the file each time.
    """
    tail = F.regexp_extract(text, BLOCK_CALL_TO_END, 0)
    match = F.regexp_extract(tail, BLOCK_UP_TO_LAST_REQUEST, 0)
    return F.when(
        F.contains(text, F.lit("$_")) & (match != ""),
        F.array(
            F.struct(tx.line_of_tail(text, tail).alias("line"), match.alias("match"))
        ),
    ).otherwise(F.array().cast(_HITS))


def apply_rules(
    files: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile, floor: str | None = None
) -> DataFrame:
    """Run any rule set over the profile's project files in one pass."""
    return run_rules(decoded(custom_files(files, profile), profile), rules, profile, floor)


def run_rules(
    texts: DataFrame, rules: Iterable[RuleSpec], profile: str | Profile, floor: str | None = None
) -> DataFrame:
    kept = at_least(rules, floor)
    if not kept:
        return texts.sparkSession.createDataFrame([], FINDING_DDL)
    if profile_of(profile).name == "line":
        return scan_lines(texts, kept)
    return scan_texts(texts, kept, profile)


def scan_security(files: DataFrame, profile: str | Profile, floor: str | None = None) -> DataFrame:
    return apply_rules(files, security_rules(profile), profile, floor)


def scan_credentials(files: DataFrame, profile: str | Profile, floor: str | None = None) -> DataFrame:
    return apply_rules(files, CREDENTIALS, profile, floor)


def scan_content(files: DataFrame, profile: str | Profile, floor: str | None = None) -> DataFrame:
    """Credential and security rules together, still one read and one pass."""
    return apply_rules(files, (*CREDENTIALS, *security_rules(profile)), profile, floor)


def is_leak_candidate(path: Column) -> Column:
    """File types checked for provider secrets; ``.env`` counts as a bare name too."""
    name = F.lower(basename(path))
    found = F.lit(False)
    for extension in LEAK_EXTENSIONS:
        found = found | F.endswith(name, F.lit(extension))
    return found


def is_allow_listed(text: Column) -> Column:
    found = F.lit(False)
    for marker in ALLOW_MARKERS:
        found = found | F.contains(text, F.lit(marker))
    return found


def scan_leaks(texts: DataFrame, floor: str | None = None) -> DataFrame:
    """Provider secrets, one finding per match; texts with an allow marker are exempt."""
    return run_rules(texts.filter(~is_allow_listed(F.col("text"))), LEAKS, "span", floor)
