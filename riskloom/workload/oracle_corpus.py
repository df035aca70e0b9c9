"""The derived source tree as DuckDB common table expressions."""

from __future__ import annotations

from riskloom.workload import corpus


def files_cte(name: str = "files", as_of: str | None = None) -> str:
    """``name(path, content)``, without the WITH keyword."""
    where = f"WHERE o_orderdate < TIMESTAMP '{as_of}'" if as_of else ""
    targets = " UNION ALL ".join(
        f"SELECT c_custkey AS file_id, {n - 8} AS pos, {sql.format(k='c_custkey')} AS target FROM customer"
        for n, sql in enumerate(corpus.TARGETS_SQL)
    )
    return f"""
{name}_paths AS (
  SELECT file_id, pos, target, {corpus.path_sql("file_id", corpus.DUCKDB)} AS own, {corpus.path_sql("target", corpus.DUCKDB)} AS path
  FROM ({targets}) t WHERE target IS NOT NULL),
{name}_bare AS (SELECT *, {corpus.BARE_SQL} AS bare FROM {name}_paths),
{name}_raw AS (SELECT *, {corpus.RAW_SQL} AS raw FROM {name}_bare),
{name}_lines AS (
  SELECT c_custkey AS file_id, -9 AS pos, '<?php' AS line FROM customer
  UNION ALL
  SELECT file_id, pos, {corpus.INCLUDE_SQL} FROM {name}_raw
  UNION ALL
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey),
         {corpus.template_sql("o_orderkey", corpus.DUCKDB)}
  FROM orders {where}),
{name}_texts AS (
  SELECT file_id, greatest(pos - 1, 0) // {corpus.FILE_LINES} AS part,
         string_agg(line, chr(10) ORDER BY pos) AS body
  FROM {name}_lines GROUP BY 1, 2),
{name} AS (
  SELECT {corpus.part_path_sql("file_id", "part", corpus.DUCKDB)} AS path,
         (CASE WHEN part > 0 THEN '<?php' || chr(10) ELSE '' END) || body AS content
  FROM {name}_texts)"""
