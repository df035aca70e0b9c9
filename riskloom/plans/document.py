"""A run as one JSON document: layouts by profile, and the rows that fill them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.model import Profile, severity_weight
from riskloom.operators import summary
from riskloom.sources.jsondoc import many, one

SCANNERS = ("credential", "security", "dead")
STATS, HUBS, ORPHANS, CYCLES, SKIPPED, SIZES = range(10, 16)


def layout_of(
    profile: Profile, ran: tuple[str, ...], with_graph: bool, root: str, generated: str | None, sizes: tuple[int, int] | None
) -> dict:
    """The document without its rows.  Scanners that did not run are empty arrays in the line profile, absent elsewhere."""
    nodes, edges = sizes or (0, 0)
    found = {s: many(n) for n, s in enumerate(SCANNERS) if s in ran}
    if profile.name == "line":
        graph = {"node_count": nodes, "edge_count": edges, "hubs": many(HUBS), "orphans": many(ORPHANS), "cycles": many(CYCLES)}
        return {
            "generated_at": generated,
            "root": root,
            "stats": one(STATS),
            **{f"{s}_findings": found.get(s, []) for s in SCANNERS},
            "dependency_results": graph if with_graph else None,
            "skipped_files": many(SKIPPED),
        }
    graph = {"nodes": nodes, "edges": edges, "hubs": many(HUBS), "orphans": many(ORPHANS), "cycles": many(CYCLES)}
    if profile.name == "span":
        findings = {("deadfile" if s == "dead" else s): found[s] for s in SCANNERS if s in found}
        meta = {"generated_at": generated, "root": root, "files": one(STATS), "skipped_files": many(SKIPPED)}
        return {"dependency": graph if with_graph else {}, "findings": findings, "meta": meta}
    scanners = {f"{s}_scanner": found[s] for s in ("security", "credential", "dead") if s in found}
    meta = {"generated_at": generated, "root": root, "stats": one(STATS), "skipped_files": many(SKIPPED)}
    return {**scanners, **({"dependency_analysis": graph} if with_graph else {}), "meta": meta}


def _json_text(value: Column) -> Column:
    """A string as a JSON value."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _rows(df: DataFrame, slot: Column | int, text: Column, k1=0, k2="", k3=0, k4="", k5="") -> DataFrame:
    def column(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    keys = ((slot, "int", "slot"), (k1, "int", "k1"), (k2, "string", "k2"), (k3, "int", "k3"), (k4, "string", "k4"), (k5, "string", "k5"))
    return df.select(*(column(v, kind).alias(name) for v, kind, name in keys), text.alias("text"))


def finding_rows(findings: DataFrame, profile: Profile) -> DataFrame:
    slot = F.array_position(F.array(*map(F.lit, SCANNERS)), F.col("scanner")) - 1
    weight = F.lit(0) if profile.name == "block" else -severity_weight(F.col("severity"))
    record = F.to_json(F.struct("file", "line", "rule", "severity", "match"), {"ignoreNullFields": "false"})
    return _rows(findings, slot, record, weight, F.col("file"), F.col("line"), F.col("rule"), F.col("match"))


def document_rows(
    profile: Profile,
    findings: DataFrame,
    stats: DataFrame,
    skipped: DataFrame | None = None,
    hubs: DataFrame | None = None,
    orphans: DataFrame | None = None,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """``(slot, text)`` in the order of the document."""
    parts = [finding_rows(findings, profile), _rows(stats, STATS, F.to_json(F.struct(*stats.columns)))]
    if skipped is not None:
        parts.append(_rows(skipped, SKIPPED, F.to_json(F.struct("path", "reason")), k2=F.col("path")))
    if hubs is not None:
        pair = F.concat(F.lit("["), _json_text(F.col("node")), F.lit(", "), F.col("in_degree").cast("string"), F.lit("]"))
        parts.append(_rows(hubs, HUBS, pair, -F.col("in_degree"), F.col("node")))
    if orphans is not None:
        parts.append(_rows(orphans, ORPHANS, _json_text(F.col("node")), k2=F.col("node")))
    if cycles is not None:
        parts.append(_rows(cycles, CYCLES, F.to_json("cycle"), F.col("length"), F.array_join("cycle", "\u0000")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.orderBy("slot", "k1", "k2", "k3", "k4", "k5").select("slot", "text")


def scanners_of(profile: Profile, mode: str) -> tuple[str, ...]:
    return summary.modes_of(profile)[mode]
