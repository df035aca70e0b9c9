"""Path expressions over root-relative posix paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.model import VENDOR_DIRS, Profile, profile_of


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def parent(path: Column) -> Column:
    """Directory part without the trailing slash; empty for files in the root."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def is_under(path: Column, root: str) -> Column:
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))


def relative_path(path: Column, root: str, fallback: str = "path") -> Column:
    """Path below ``root``; outside of it the full path or only the name."""
    inside = F.substring(path, len(root.rstrip("/")) + 2, 2**31 - 1)
    outside = basename(path) if fallback == "name" else path
    return F.when(is_under(path, root), inside).otherwise(outside)


def is_vendor(relpath: Column, profile: str | Profile) -> Column:
    rule = profile_of(profile).vendor_rule
    if rule == "component":
        # Entries with a slash never equal a single component.
        return F.arrays_overlap(F.split(relpath, "/"), F.array(*map(F.lit, VENDOR_DIRS)))
    if rule == "rooted_hidden":
        # Leading dots and slashes do not count, so ".vendor/x" is vendor code.
        relpath = F.regexp_replace(relpath, r"^[./]+", "")
    return F.rlike(relpath, F.lit(f"^(?:{'|'.join(map(re.escape, VENDOR_DIRS))})(?:/|\\z)"))


def is_custom(path: Column, profile: str | Profile, root: str | None = None) -> Column:
    """True for project code.  With ``root`` the path is absolute.

    A path outside the root is not project code, except in the span profile,
    which then judges the path itself.
    """
    prof = profile_of(profile)
    if root is None:
        return ~is_vendor(path, prof)
    custom = ~is_vendor(relative_path(path, root), prof)
    return custom if prof.vendor_rule == "rooted_hidden" else is_under(path, root) & custom


def is_php(path: Column, profile: str | Profile) -> Column:
    name = F.lower(path) if profile_of(profile).extension_any_case else path
    return F.endswith(name, F.lit(".php"))


def normalize_path(path: Column) -> Column:
    """Fold ``.``, ``..`` and double slashes without touching a file system.

    In an absolute path ``..`` stops at ``/``.  In a relative one a ``..`` that
    climbs above the start stays, so the result equals no file of the tree.
    """
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            (part == "..") & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != ".."),
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .when((part == "..") & absolute, done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def ancestors(path: Column) -> Column:
    """Every directory above a file, the root (empty string) included."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def lacks_suffix(path: Column) -> Column:
    """No extension on the last component; a leading dot starts none."""
    return ~F.rlike(basename(path), F.lit(r"^.+\.[^.]+\z"))
