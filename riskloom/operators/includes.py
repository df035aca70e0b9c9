"""The include graph: extraction, path resolution, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.paths import ancestors, is_custom, is_php, lacks_suffix, normalize_path, parent
from riskloom.functions.text import INLINE_SPACE, LINE_BREAKS, strip
from riskloom.model import Profile, profile_of
from riskloom.operators.scan import custom_files, decoded
from riskloom.operators.skew import HEAVY_MIN_ROWS, join_unique
from riskloom.session import materialize

# Include statements.  The line-wise forms are written so that no
# part crosses a line break, which lets them run on the whole text at once.
_WORD = r"(?:include|require)(?:_once)?"
_S = INLINE_SPACE
_LITERAL = rf"['\"]([^'\"{LINE_BREAKS}]+)['\"]"
LITERAL_INCLUDE = rf"(?iU)\b{_WORD}{_S}*\(?{_S}*{_LITERAL}"
DIR_INCLUDE = (
    rf"(?iU)\b{_WORD}{_S}*\(?{_S}*"
    rf"(?:dirname{_S}*\({_S}*__FILE__{_S}*\)|__DIR__){_S}*\.{_S}*{_LITERAL}"
)
STATEMENT_INCLUDE = rf"(?iU)\b{_WORD}\b{_S}*(?:\({_S}*)?([^;{LINE_BREAKS}]+?){_S}*\)?{_S}*;"
BLOCK_INCLUDE = rf"(?iU){_WORD}\s*\(?\s*['\"]([^'\"]+)['\"]"
WHOLE_LITERAL = r"(?s)^(['\"])(.+)\1\z"

# Stands for the unknown absolute location of the tree.
_ROOT = "/@tree"


def literal_includes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LITERAL_INCLUDE), F.lit(1))


def dir_includes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DIR_INCLUDE), F.lit(1))


def statement_includes(text: Column) -> Column:
    """Arguments that are exactly one quoted literal, quotes removed."""
    arguments = F.regexp_extract_all(text, F.lit(STATEMENT_INCLUDE), F.lit(1))
    raws = F.transform(arguments, lambda a: F.regexp_extract(strip(a), WHOLE_LITERAL, 2))
    return F.filter(raws, lambda raw: raw != "")


def block_includes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BLOCK_INCLUDE), F.lit(1))


def raw_includes(text: Column, profile: str | Profile) -> Column:
    """All literal include paths of a text, in the profile's form."""
    name = profile_of(profile).name
    if name == "line":
        return F.concat(literal_includes(text), dir_includes(text))
    return statement_includes(text) if name == "span" else block_includes(text)


def extract_includes(texts: DataFrame, profile: str | Profile) -> DataFrame:
    """``(src, raw)``: distinct literal include paths per file, map-only."""
    raws = raw_includes(F.col("text"), profile)
    return texts.select(F.col("path").alias("src"), F.explode(F.array_distinct(raws)).alias("raw"))


def candidates(includes: DataFrame, profile: str | Profile, root: str | None = None) -> DataFrame:
    """``(src, raw, prio, path)``: places an include may point at, inside the tree.

    ``root`` is the absolute location of the tree, for absolute include paths.
    """
    prof = profile_of(profile)
    root = root.rstrip("/") if root else _ROOT
    raw = strip(F.col("raw")) if prof.name == "span" else F.col("raw")
    absolute = F.startswith(raw, F.lit("/"))
    from_dir = F.when(absolute, raw).otherwise(
        F.concat(F.lit(f"{root}/"), parent(F.col("src")), F.lit("/"), raw)
    )
    from_root = F.concat(F.lit(f"{root}/"), F.regexp_replace(raw, "^/+", ""))
    if prof.name == "block":
        places = [from_dir]
    elif prof.name == "line":
        places = [from_dir, from_root]
    else:
        # Absolute means below the root; a missing suffix also tries .php; no URLs.
        local = F.when(~F.contains(raw, F.lit("://")), raw)
        from_dir = F.when(absolute, F.lit(None)).otherwise(
            F.concat(F.lit(f"{root}/"), parent(F.col("src")), F.lit("/"), local)
        )
        from_root = F.concat(F.lit(f"{root}/"), F.regexp_replace(local, "^/+", ""))
        places = [from_dir, from_root]
    placed = (
        includes.select("src", "raw", F.posexplode(F.array(*places)).alias("prio", "place"))
        .filter("place is not null")
        .withColumn("place", normalize_path(F.col("place")))
    )
    if prof.name == "span":
        # Each place is folded once; the one with .php comes right after it.
        both = F.array(F.col("place"), _with_php(F.col("place")))
        placed = placed.select("src", "raw", F.col("prio").alias("nth"), F.posexplode(both).alias("php", "place"))
        placed = placed.select("src", "raw", (2 * F.col("nth") + F.col("php")).alias("prio"), "place")
    return placed.filter(F.startswith("place", F.lit(f"{root}/")) | (F.col("place") == root)).select(
        "src", "raw", "prio", F.substring("place", len(root) + 2, 2**31 - 1).alias("path")
    )


def _with_php(folded: Column) -> Column:
    """A folded place with ``.php`` if it lacks a suffix, so ``lib/`` is ``lib.php`` too."""
    return F.when(lacks_suffix(folded), F.concat(folded, F.lit(".php")))


def existing_paths(listing: DataFrame, profile: str | Profile) -> DataFrame:
    """``(path, is_node)``, unique: every file and directory of the unfiltered tree."""
    prof = profile_of(profile)
    node = is_php(F.col("path"), prof) & is_custom(F.col("path"), prof)
    files = listing.select("path", node.alias("is_node"))
    if prof.name == "block":
        return files.filter("is_node")
    dirs = listing.select(F.explode(ancestors(F.col("path"))).alias("path"), F.lit(False).alias("is_node"))
    return files.unionByName(dirs.distinct())


def resolve_includes(
    includes: DataFrame,
    listing: DataFrame,
    profile: str | Profile,
    root: str | None = None,
    heavy_min_rows: int = HEAVY_MIN_ROWS,
) -> DataFrame:
    """``(src, raw, dst, is_node)``: the first place that exists, per include.

    A place wins even when it is no project file; such includes give no edge.
    A popular target is the heavy key of this join.  The places are looked at
    more than once, so they are materialized; ``includes`` is read once.
    """
    placed = materialize(candidates(includes, profile, root))
    found = join_unique(placed, existing_paths(listing, profile), "path", min_rows=heavy_min_rows)
    if profile_of(profile).name == "block":
        # One place per include: nothing to choose from.
        return found.select("src", "raw", F.col("path").alias("dst"), "is_node")
    return (
        found.groupBy("src", "raw")
        .agg(F.min_by(F.struct("path", "is_node"), "prio").alias("first"))
        .select("src", "raw", F.col("first.path").alias("dst"), F.col("first.is_node").alias("is_node"))
    )


def include_edges(
    files: DataFrame,
    profile: str | Profile,
    listing: DataFrame | None = None,
    root: str | None = None,
    heavy_min_rows: int = HEAVY_MIN_ROWS,
) -> DataFrame:
    """``(src, dst)``: distinct edges between project files, self-loops kept.

    Contents are read once: the include statements, a thin table, are
    materialized before they are resolved.
    """
    texts = decoded(custom_files(files, profile), profile)
    includes = materialize(extract_includes(texts, profile))
    paths = listing if listing is not None else files.select("path")
    return edges_from(includes, paths, profile, root, heavy_min_rows)


def edges_from(
    includes: DataFrame,
    listing: DataFrame,
    profile: str | Profile,
    root: str | None = None,
    heavy_min_rows: int = HEAVY_MIN_ROWS,
) -> DataFrame:
    """Edges of include paths that are extracted and written already."""
    resolved = resolve_includes(includes, listing, profile, root, heavy_min_rows)
    return resolved.filter("is_node").select("src", "dst").distinct()


def include_nodes(listing: DataFrame, profile: str | Profile) -> DataFrame:
    """``(path)``: every project file, isolated ones included."""
    return custom_files(listing, profile).select("path")
