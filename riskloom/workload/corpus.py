"""A source tree derived from the customer and orders tables.

The given tables hold no PHP, so each customer becomes a file and each order a
line of it.  The expressions below are plain SQL that Spark and DuckDB read
alike, which lets the SQL check rebuild the same tree.

A file never holds more than ``FILE_LINES`` order lines: further orders of the
same customer go to follow-up files.  So a customer with a third of all orders
gives many bounded files instead of one unbounded group.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import run_dir

FILE_LINES = 1000
RANK_RANGE = 100_000
LINES_PER_TASK = 1_000_000

# One line template per slot.  ~ is a single quote, ^ a line
# feed, <cr> a carriage return, <ff> a form feed.
TEMPLATES = (
    "$id = $_GET[~id~];",
    '$r = $db->query("SELECT * FROM t WHERE id = " . $id);',
    '$db->execute("DELETE FROM s WHERE tok = " . $_REQUEST[~tok~]);',
    "echo $_GET[~name~];",
    "echo htmlspecialchars($_POST[~c~]);",
    "eval($code);",
    "$o = shell_exec(~ls~); system(~id~);",
    "curl_exec($ch);",
    "include $page;",
    "require_once ~inc/common.php~;",
    "header(~Location: ~ . $_GET[~to~]);",
    "define(~API_KEY~, ~abc123def~);",
    "$db_password = ~hunter2~;",
    "$n = (int) $_GET[~n~];",
    "$st->execute([$n]);",
    "$m = new mysqli(~h~, ~u~, ~p4ss~, ~d~);",
    "$api_token = ~QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWY=~;",
    "$pay = ~sk" + "_live_" + "0a1b2c3d" * 3 + "~;",
    "// PLACEHOLDER values below",
    "$pw = getenv(~DB_PASSWORD~);",
    'header("Location: /x?u=" . $_GET[~u~]);',
    'header("Location:" . $_POST[~u~]);',
    '$db->query(^  "SELECT " . $_POST[~q~]^);',
    'echo "<p>" . $_GET[~t~] . "</p>"; // a | b',
    "$retrieval = retrieval($x); eval^($y);",
    "include(~uploads/~ . $file);",
    "require ~lib~ . $mod . ~.php~;",
    "$name = $_COOKIE[~n~];<cr>^$q2 = $pdo->execute($names);",
    "<ff>exec(~x~);",
    '    $db->query("SELECT a, b, c,   d, e, f FROM some_long_table_name WHERE a = 1 AND b = 2 '
    'AND c = 3 AND d = 4 AND e = 5 AND f = 6 AND g = 7 AND h = 8 AND i = " . $_GET[~i~]);',
    "",
    "$cloud = ~AKIA" + "Q7" * 8 + "~;",
    "-----BEGIN RSA " + "PRIVATE KEY-----",
    "$hub = ~gh" + "p_" + "a1B2c3" * 6 + "~;",
    "print strip_tags($_GET[~x~]); echo intval($_GET[~i~]);",
    "$url = urlencode($_GET[~u~]);",
    "$id2 = $_POST[~id2~]; $x = 1;",
)

# Directory by key % 8.
DIRECTORIES = (
    "vendor/lib/",
    "google_config/",
    "mailer/vendor/",
    "app/",
    "app/admin/",
    "lib/",
    "classes/mailer/",
    "app/vendor/",
)

# File name by key % 23 as the text before and after the key.
DEFAULT_NAME = ("f", ".php")
NAMES = {
    0: ("backup_f", ".php"),
    1: ("_f", ".php"),
    2: ("f", "-old.php"),
    3: ("demo-abcdefghij", "-x.php"),
    4: ("d", "/phpinfo.php"),
    5: ("f", ".PHP"),
    6: ("notes", ".txt"),
    7: ("x---f", ".php"),
    8: ("w", "/wp-config.php"),
    10: ("e", "/.env"),
    11: ("b", "/device.bcakup.php"),
    12: ("demo-abcde", "-x.php"),
    13: ("d", ".php/index.php"),
    14: ("tool", ".py"),
    16: ("m", "/Main.php"),
}
NAME_SLOTS = 23

SPARK = "element_at(array({values}), cast({index} + 1 as int))"
DUCKDB = "list_extract(list_value({values}), {index} + 1)"


def pick(values, index: str, dialect: str) -> str:
    """Look up one of a few literals.  An array folds to a constant, while a
    long CASE would grow past the size the JVM compiles."""
    return dialect.format(values=", ".join(values), index=index)


def _quoted(values) -> list[str]:
    return [f"'{v}'" for v in values]


def path_sql(key: str, dialect: str = SPARK) -> str:
    """Path of the file with the given integer key expression."""
    slots = [NAMES.get(i, DEFAULT_NAME) for i in range(NAME_SLOTS)]
    text = f"cast({key} as string)"
    name = (
        f"{pick(_quoted(h for h, _ in slots), f'{key} % {NAME_SLOTS}', dialect)} || {text}"
        f" || {pick(_quoted(t for _, t in slots), f'{key} % {NAME_SLOTS}', dialect)}"
    )
    directory = pick(_quoted(DIRECTORIES), f"{key} % 8", dialect)
    # Next to every second wp-config.php lies a wp-includes directory.
    sibling = pick(_quoted(DIRECTORIES), f"({key} - 1) % 8", dialect)
    return (
        f"(CASE WHEN {key} % {NAME_SLOTS} = 15 AND {key} % 2 = 0 THEN '.vendor/f' || {text} || '.php'"
        f" WHEN {key} % {NAME_SLOTS} = 17 AND {key} % 4 = 0 THEN 'lib/wp-admin/f' || {text} || '.php'"
        f" WHEN {key} % {NAME_SLOTS} = 9 AND {key} % 2 = 1"
        f" THEN {sibling} || 'w' || cast({key} - 1 as string) || '/wp-includes/load.php'"
        f" ELSE {directory} || {name} END)"
    )


def part_path_sql(key: str, part: str, dialect: str = SPARK) -> str:
    """Follow-up files of a customer get a directory of their own."""
    return (
        f"((CASE WHEN {part} = 0 THEN '' ELSE 'parts/p' || cast({part} as string) || '/' END)"
        f" || {path_sql(key, dialect)})"
    )


def template_sql(number: str, dialect: str = SPARK) -> str:
    """Text of an order line, chosen by the order key."""
    texts = []
    for template in TEMPLATES:
        text = f"'{template}'"
        for token, code in (("~", 39), ("^", 10), ("<cr>", 13), ("<ff>", 12)):
            if token in template:
                text = f"replace({text}, '{token}', chr({code}))"
        texts.append(text)
    return pick(texts, f"{number} % {len(TEMPLATES)}", dialect)


# Targets of a file's include statements, by key: the head of its block of ten,
# inside a block a few cycles, and one file that every block head includes.
TARGETS_SQL = (
    ("CASE WHEN {k} % 10 <> 0 THEN {k} - {k} % 10 ELSE 5 END"),
    ("CASE WHEN {k} % 30 = 0 THEN {k} + 1 WHEN {k} % 30 = 2 THEN {k} - 1 END"),
    ("CASE WHEN {k} % 30 = 0 THEN {k} + 2 END"),
)


# One include statement from file_id, target, own (path) and path (of the
# target); form, quoting and path style vary with the keys.
BARE_SQL = "CASE WHEN (file_id + target) % 11 = 0 THEN replace(path, '.php', '') ELSE path END"
RAW_SQL = (
    "CASE (file_id - file_id % 10) % 7 % 3 WHEN 0 THEN bare"
    " WHEN 1 THEN repeat('../', cast(length(own) - length(replace(own, '/', '')) as int)) || bare"
    " ELSE '/' || bare END"
)
INCLUDE_SQL = (
    "CASE (file_id + target) % 5"
    " WHEN 0 THEN 'include ' || chr(39) || raw || chr(39) || ';'"
    " WHEN 1 THEN 'require_once(\"' || raw || '\");'"
    " WHEN 2 THEN '  require ' || chr(39) || raw || chr(39) || ' ;'"
    " WHEN 3 THEN 'include_once(__DIR__ . ' || chr(39) || '/' || raw || chr(39) || ');'"
    " ELSE 'INCLUDE (' || chr(39) || raw || chr(39) || ' );' END"
)


def numbered_orders(orders: DataFrame) -> DataFrame:
    """Position of every order within its customer, safe for hot customers.

    A plain window would sort all orders of one customer in one task.  Here
    orders are ranked inside (customer, key range) groups, which hold at most
    ``RANK_RANGE`` rows because order keys are unique, and the number of orders
    in earlier ranges is added.  Only the counts per range are summed up per
    customer.
    """
    keyed = orders.select(
        "o_custkey",
        "o_orderkey",
        F.floor(F.col("o_orderkey") / RANK_RANGE).cast("long").alias("key_range"),
    )
    before = W.partitionBy("o_custkey").orderBy("key_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("o_custkey", "key_range")
        .agg(F.count("*").alias("n"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("o_custkey", "key_range", "earlier")
    )
    within = W.partitionBy("o_custkey", "key_range").orderBy("o_orderkey")
    return (
        keyed.withColumn("pos", F.row_number().over(within))
        .join(offsets, ["o_custkey", "key_range"])
        .select("o_custkey", "o_orderkey", (F.col("earlier") + F.col("pos")).alias("pos"))
    )


def source_lines(orders: DataFrame) -> DataFrame:
    """``(file_id, part, pos, line, path)``: one template line per order.

    The path is set on the first line of each follow-up file.
    """
    numbered = numbered_orders(orders).select(
        F.col("o_custkey").alias("file_id"),
        F.floor((F.col("pos") - 1) / FILE_LINES).cast("long").alias("part"),
        "pos",
        F.expr(template_sql("o_orderkey")).alias("line"),
    )
    opens_part = (F.col("part") > 0) & ((F.col("pos") - 1) % FILE_LINES == 0)
    return numbered.withColumn(
        "path", F.when(opens_part, F.expr(part_path_sql("file_id", "part")))
    )


def include_lines(listing: DataFrame) -> DataFrame:
    """``(file_id, part, pos, line)``: the include statements of the first files."""
    targets = F.array(
        *[
            F.struct(F.lit(n - 8).cast("long").alias("pos"), F.expr(sql.format(k="file_id")).alias("target"))
            for n, sql in enumerate(TARGETS_SQL)
        ]
    )
    return (
        listing.select("file_id", F.col("path").alias("own"), F.inline(targets))
        .filter("target is not null")
        .select("file_id", "own", "pos", "target", F.expr(path_sql("target")).alias("path"))
        .withColumn("bare", F.expr(BARE_SQL))
        .withColumn("raw", F.expr(RAW_SQL))
        .select("file_id", F.lit(0).cast("long").alias("part"), "pos", F.expr(INCLUDE_SQL).alias("line"))
    )


def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, path)`` of the customers' first files."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("file_id"), F.expr(path_sql("c_custkey")).alias("path")
    )


def derive_files(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    """``(path, content)`` of the derived tree; ``as_of`` gives an earlier state.

    A customer without orders is a file with only its head.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if as_of is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(as_of).cast("timestamp"))
    listing = source_listing(spark, sf_dir)
    first_part = F.lit(0).cast("long").alias("part")
    tags = listing.select(
        "file_id", first_part, F.lit(-9).cast("long").alias("pos"), F.lit("<?php").alias("line"), "path"
    )
    imports = include_lines(listing).withColumn("path", F.lit(None).cast("string"))
    lines = tags.unionByName(imports).unionByName(source_lines(orders))
    # The number of tasks follows the number of lines.  The path is an
    # aggregate, not a grouping key, so that filters on it do not copy its long
    # expression below the shuffle.
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // LINES_PER_TASK))
    texts = lines.repartition(tasks, "file_id", "part").groupBy("file_id", "part").agg(
        F.max("path").alias("path"),
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("body"),
    )
    return texts.select(
        "path",
        F.concat(
            F.when(F.col("part") > 0, F.lit("<?php\n")).otherwise(F.lit("")),
            F.array_join(F.col("body.line"), "\n"),
        ).alias("content"),
    )


_TABLES: dict[tuple[str, str, str | None], str] = {}


def source_files(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    """The derived tree as a table, written once per application to the shared
    folder, so that queries scan stored files as they would in a real run."""
    key = (spark.sparkContext.applicationId, sf_dir, as_of)
    stored = spark.read.schema("path string, content string")
    if key in _TABLES:
        try:
            return stored.parquet(_TABLES[key])
        except AnalysisException:
            # Somebody cleared the folder; write it again.
            del _TABLES[key]
    folder = run_dir(spark, "source-files")
    derive_files(spark, sf_dir, as_of).write.parquet(folder)
    _TABLES[key] = folder
    return stored.parquet(folder)
