"""File-name rules for leftover, backup and demo files.  Content is never read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.paths import basename, is_custom, parent
from riskloom.model import Profile, profile_of, weight_of
from riskloom.operators.scan import custom_files

# Line profile, in order of precedence.
EXACT_NAMES = ("wp-config.php", "wp-config-sample.php", "phpinfo.php", "info.php", "test.php")
DEMO_NAME = r"demo-[a-z0-9]{10,}-"
DISABLED_PREFIX = r"(?U)^(?:x---|_|-)\w"
SUSPICIOUS_PARTS = (
    "backup",
    "bak",
    ".bak",
    "bcakup",
    "-old",
    "-last-",
    "0ld",
    "_old",
    ".old",
    "tmp",
    "copy",
    "-copy",
    "_copy",
    "test",
    "debug",
    "123",
)

# Span profile.
SPAN_PREFIXES = ("x---", "_", "-")
SPAN_BACKUP_PARTS = ("backup", ".bcakup", ".bak", " bak", "old", "tmp", "copy", "test", "debug")
SPAN_SUFFIX_PARTS = ("-old", "-last-", "123", "0ld")
SPAN_DEMO_NAME = r"demo-[a-z0-9]{8,}-"
WP_ROOT_ENTRIES = ("wp-includes", "wp-admin", "wp-settings.php")

# Block profile.  The pattern text is part of the finding.
BLOCK_NAME_RULES = (
    ("backup_extension", "INFO", r"device\.bcakup\.php"),
    ("backup_in_name", "LOW", r".*(backup|bak|old|tmp|copy|test|debug|-last-|\d{3,}|-old|0ld).*\.php$"),
    ("special_prefix", "MEDIUM", r"^(?:x--|_|-).*\.php$"),
    ("dangerous_demo", "HIGH", r"demo-[a-z0-9]{10,}.*\.php$"),
    ("misplaced_wp_config", "CRITICAL", r"wp-config\.php"),
)


def _any_of(test, name: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [test(name, F.lit(p)) for p in parts])


def first_reason(name: Column) -> Column:
    """First matching reason, NULL when the name is fine (line profile)."""
    low = F.lower(name)
    reason = (
        F.when(low.isin(*EXACT_NAMES), F.concat(F.lit("known dangerous filename: "), name))
        .when(F.rlike(low, F.lit(DEMO_NAME)), F.concat(F.lit("demo file pattern: "), name))
        .when(F.rlike(low, F.lit(DISABLED_PREFIX)), F.concat(F.lit("special prefix in filename: "), name))
    )
    for part in SUSPICIOUS_PARTS:
        reason = reason.when(
            F.contains(low, F.lit(part)),
            F.concat(F.lit(f"suspicious substring '{part}' in filename: "), name),
        )
    return reason


def all_reasons(name: Column, wordpress: Column) -> Column:
    """All matching reasons joined by ``;``, empty when there is none (span profile)."""
    low = F.lower(name)
    return F.concat_ws(
        ";",
        F.when(_any_of(F.startswith, low, SPAN_PREFIXES), F.lit("suspicious_prefix")),
        F.when(_any_of(F.contains, low, SPAN_BACKUP_PARTS), F.lit("backup_or_temp")),
        F.when(_any_of(F.contains, low, SPAN_SUFFIX_PARTS), F.lit("suspicious_suffix")),
        F.when(F.rlike(low, F.lit(SPAN_DEMO_NAME)), F.lit("demo_pattern")),
        F.when((low == "wp-config.php") & ~wordpress, F.lit("wp_config_outside_wordpress")),
    )


def name_rules(name: Column, rules=BLOCK_NAME_RULES) -> Column:
    """Array of (rule, severity, match), one entry per matching rule (block profile)."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.rlike(name, F.lit(f"(?i)^(?:{pattern})")),
                    F.struct(
                        F.lit(f"deadfile_{rule}").alias("rule"),
                        F.lit(severity).alias("severity"),
                        F.lit(f"Filename matches pattern: {pattern}").alias("match"),
                    ),
                )
                for rule, severity, pattern in rules
            ]
        )
    )


def has_wordpress_root(listing: DataFrame) -> Column:
    """Scalar subquery: does the root of the tree hold WordPress entries?"""
    top = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    return listing.filter(top.isin(*WP_ROOT_ENTRIES)).select(F.lit(1)).limit(1).exists()


def wordpress_dirs(listing: DataFrame) -> DataFrame:
    """Directories that directly contain a wp-includes entry."""
    return (
        listing.filter(F.rlike("path", F.lit(r"(?:^|/)wp-includes(?:/|\z)")))
        .select(F.explode(_wp_parents(F.col("path"))).alias("dir"))
        .distinct()
    )


def _wp_parents(path: Column) -> Column:
    """Parents of every wp-includes component of a path."""
    parts = F.split(path, "/", -1)
    indexes = F.filter(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1) == "wp-includes"
    )
    return F.transform(indexes, lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))


def _shape(findings: DataFrame, prof: Profile) -> DataFrame:
    return findings.select(
        F.lit("dead").alias("scanner"),
        F.col("path").alias("file"),
        F.lit(prof.dead_line).alias("line"),
        "rule",
        "severity",
        "match",
    )


def scan_names(
    listing: DataFrame, profile: str | Profile, floor: str | None = None
) -> DataFrame:
    """Dead-file findings over a listing that still holds vendor and non-PHP files.

    The floor has no effect in the line profile.
    """
    prof = profile_of(profile)
    name = basename(F.col("path"))
    if prof.name == "line":
        found = custom_files(listing, prof).select("path", first_reason(name).alias("match"))
        found = found.filter("match is not null").select(
            "path", F.lit("dead_file").alias("rule"), F.lit("MEDIUM").alias("severity"), "match"
        )
    elif prof.name == "span":
        if floor is not None and weight_of(floor) > weight_of("LOW"):
            return _shape(_nothing(listing), prof)
        found = (
            listing.filter(is_custom(F.col("path"), prof))
            .select("path", all_reasons(name, has_wordpress_root(listing)).alias("match"))
            .filter("match <> ''")
            .select(
                "path",
                F.lit("dead_or_backup_file").alias("rule"),
                F.lit("LOW").alias("severity"),
                "match",
            )
        )
    else:
        # Rules below the floor are left out; they all have one severity.
        kept = [r for r in BLOCK_NAME_RULES if floor is None or weight_of(r[1]) >= weight_of(floor)]
        plain = [r for r in kept if r[0] != "misplaced_wp_config"]
        placed = [r for r in kept if r[0] == "misplaced_wp_config"]
        custom = custom_files(listing, prof)
        parts = [custom.select("path", F.inline(name_rules(name, plain)))] if plain else []
        if placed:
            # Only the few wp-config files take part in the join.
            config = custom.filter(F.rlike(name, F.lit(f"(?i)^(?:{placed[0][2]})")))
            outside = config.withColumn("dir", parent(F.col("path"))).join(
                wordpress_dirs(listing), "dir", "left_anti"
            )
            parts.append(outside.select("path", F.inline(name_rules(name, placed))))
        found = reduce(DataFrame.unionByName, parts)
    return _shape(found, prof)


def _nothing(listing: DataFrame) -> DataFrame:
    return listing.filter(F.lit(False)).select(
        "path", F.lit("").alias("rule"), F.lit("LOW").alias("severity"), F.lit("").alias("match")
    )
