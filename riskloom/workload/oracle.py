"""The queries again as plain SQL for DuckDB, written apart from the Spark plans.

Patterns are RE2; offsets, path folding and cycle search use SQL lists and
recursive common table expressions.
"""

from __future__ import annotations

from riskloom.workload import corpus
from riskloom.workload.oracle_corpus import files_cte
from riskloom.workload.queries import HUB, SNAPSHOT_DATE, SUCCESSORS_OF

LF = "chr(10)"
ROOTED = r"'^(google_config|vendor|fb_config|mailer/vendor|test/PHPExcel|classes/mailer)(/|$)'"
VENDOR = {
    "line": f"regexp_matches(path, {ROOTED})",
    "span": f"regexp_matches(ltrim(path, './'), {ROOTED})",
    "block": (
        "list_has_any(string_split(path, '/'), ['google_config', 'vendor', 'fb_config',"
        " 'mailer/vendor', 'test/PHPExcel', 'classes/mailer'])"
    ),
}
PHP = {
    "line": "lower(path) LIKE '%.php'",
    "span": "lower(path) LIKE '%.php'",
    "block": "path LIKE '%.php'",
}
SG3 = r"\$_(?:GET|POST|REQUEST)"
SG4 = r"\$_(?:GET|POST|REQUEST|COOKIE)"


def with_files(*ctes: str, name: str = "files") -> str:
    return "WITH RECURSIVE " + ",".join([files_cte(name), *ctes])


def custom_cte(profile: str, source: str = "files", name: str = "custom") -> str:
    return f"{name} AS (SELECT * FROM {source} WHERE {PHP[profile]} AND NOT {VENDOR[profile]})"


def texts_cte(source: str = "custom", name: str = "texts") -> str:
    return (
        f"{name} AS (SELECT path, replace(replace(content, chr(13) || {LF}, {LF}), chr(13), {LF})"
        f" AS text FROM {source})"
    )


def lines_cte(source: str = "texts", name: str = "lines") -> str:
    return rf"""{name} AS (
  SELECT path, cast(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line
  FROM (SELECT path, string_split_regex(regexp_replace(text, '[\n\x0b\x0c]$', ''), '[\n\x0b\x0c]') AS ls
        FROM {source} WHERE text <> '') t)"""


def line_prelude(profile: str = "line") -> str:
    return with_files(custom_cte(profile), texts_cte(), lines_cte())


def text_prelude(profile: str) -> str:
    return with_files(custom_cte(profile), texts_cte())


def stripped(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def shortened(expr: str, limit: int = 160) -> str:
    flat = rf"regexp_replace({stripped(expr)}, '\s+', ' ', 'g')"
    return (
        f"CASE WHEN length({flat}) <= {limit} THEN {flat}"
        f" ELSE substring({flat}, 1, {limit - 1}) || chr(8230) END"
    )


# ------------------------------------------------------------- line rules

# Tokens that make a line count as sanitized.
SANITIZER_TOKENS = (
    "htmlspecialchars",
    "htmlentities",
    "strip_tags",
    "filter_input",
    "filter_var",
    "intval",
    "floatval",
    "(int)",
    "(float)",
    "mysqli_real_escape_string",
    "addslashes",
    "prepare(",
)
SANITIZED = " OR ".join(f"contains(lower(line), '{t}')" for t in SANITIZER_TOKENS)
Q = "[''\"]"
SECRET = r"\$\w*(?:key|secret|token|password)\w*\s*=\s*"
LITERAL = "(?:''[^'']+''|\"[^\"]+\")"
B64 = "(?:[A-Za-z0-9+/]{41,}={0,2}|[A-Za-z0-9+/]{40}={1,2}|[A-Za-z0-9+/]{39}==)"


def _line(pattern: str) -> str:
    return f"regexp_matches(line, '(?i){pattern}')"


LINE_RULES = {
    ("security", "sql_injection", "CRITICAL"): (
        "(" + _line(rf"(?:->|\b)(?:query|execute)\s*\(.*{SG3}\s*\[") + " OR "
        + _line(rf"(?:->|\b)(?:query|execute)\s*\([^)]*\.\s*{SG3}") + f") AND NOT ({SANITIZED})"
    ),
    ("security", "eval_usage", "HIGH"): _line(r"\beval\s*\("),
    ("security", "xss_direct_echo", "HIGH"): _line(rf"\becho\b.*{SG4}\s*\[") + f" AND NOT ({SANITIZED})",
    ("security", "dynamic_include", "HIGH"): (
        "(" + _line(rf"\b(?:include|require)(?:_once)?\s*[(\s]{Q}*\s*\$\w") + " OR "
        + _line(rf"\b(?:include|require)(?:_once)?\s*\(?\s*(?:{Q}\w+{Q}\s*\.\s*)?\$\w") + ")"
    ),
    ("security", "shell_exec", "CRITICAL"): _line(r"\b(?:shell_exec|exec|system|passthru)\s*\("),
    ("security", "open_redirect", "MEDIUM"): _line(rf"header\s*\(\s*{Q}Location:\s*{Q}?\s*\.\s*\$_"),
    ("credential", "hardcoded_db_password", "CRITICAL"): _line(
        rf"\bnew\s+(?:mysqli|MysqliDb)\s*\([^,;]*,[^,;]*,\s*{LITERAL}"
    ),
    ("credential", "define_secret", "CRITICAL"): _line(
        rf"\bdefine\s*\(\s*{Q}[^''\"]*(?:KEY|SECRET|PASSWORD|TOKEN)[^''\"]*{Q}\s*,\s*{LITERAL}"
    ),
    ("credential", "hardcoded_assignment", "HIGH"): _line(SECRET + LITERAL),
    ("credential", "base64_encoded_key", "HIGH"): _line(SECRET + Q + B64 + Q),
}
ORDER = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}


def line_findings(keep=lambda scanner, rule, severity: True, source: str = "lines") -> str:
    return " UNION ALL ".join(
        f"SELECT '{scanner}' AS scanner, path AS file, line_no AS line, '{rule}' AS rule,"
        f" '{severity}' AS severity, {stripped('line')} AS match FROM {source} WHERE {test}"
        for (scanner, rule, severity), test in LINE_RULES.items()
        if keep(scanner, rule, severity)
    )


# ------------------------------------------------- whole-text match rules

SPAN_PATTERNS = {
    ("security", "eval_usage", "HIGH"): r"(?i)\beval\s*\(",
    ("security", "shell_exec", "CRITICAL"): r"(?i)\b(?:shell_exec|exec|system|passthru)\s*\(",
    ("security", "dynamic_include", "HIGH"): (
        r"(?i)\b(?:include_once|include|require_once|require)\s*(?:\(\s*)?\$[A-Za-z_][A-Za-z0-9_]*"
    ),
    ("security", "xss_direct_echo", "HIGH"): rf"(?i)\becho\s+{SG4}\b",
    ("security", "open_redirect", "MEDIUM"): (
        r"(?is)\bheader\s*\(\s*(?:''Location:.*?''|\"Location:.*?\")\s*\.\s*\$_"
    ),
}
BLOCK_PATTERNS = {
    ("security", "eval_usage", "HIGH"): r"(?i)eval\s*\(",
    ("security", "shell_exec", "CRITICAL"): r"(?i)(?:shell_exec|exec|system|passthru)\s*\(",
    ("security", "dynamic_include", "HIGH"): r"(?i)(?:include|require)(?:_once)?\s*\(?\$",
    ("security", "xss_direct_echo", "HIGH"): rf"(?i)echo\s+{SG4}\s*\[",
    ("security", "open_redirect", "MEDIUM"): rf"(?i)header\s*\(\s*{Q}Location:\s*{Q}\s*\.\s*\$_",
}
CREDENTIAL_PATTERNS = {
    ("credential", "hardcoded_db_password", "CRITICAL"): (
        rf"(?i)\bnew\s+(?:mysqli|MysqliDb)\s*\([^,;]*,[^,;]*,\s*{LITERAL}"
    ),
    ("credential", "define_secret", "CRITICAL"): (
        rf"(?i)\bdefine\s*\(\s*{Q}[^''\"]*(?:KEY|SECRET|PASSWORD|TOKEN)[^''\"]*{Q}\s*,\s*{LITERAL}"
    ),
    ("credential", "hardcoded_assignment", "HIGH"): "(?i)" + SECRET + LITERAL,
    ("credential", "base64_encoded_key", "HIGH"): "(?i)" + SECRET + Q + B64 + Q,
}
LEAK_PATTERNS = {
    ("leak", "live_payment_key", "CRITICAL"): r"\b[rs]k_live_[0-9A-Za-z]{16,}",
    ("leak", "cloud_access_key", "CRITICAL"): r"\bA[KS]IA[0-9A-Z]{16}\b",
    ("leak", "code_host_token", "CRITICAL"): r"\bgh[opsur]_[0-9A-Za-z]{36,}",
    ("leak", "private_key", "CRITICAL"): "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    ("leak", "hardcoded_password", "HIGH"): (
        r"(?i)(?:password|passwd|token)[''\"]?\s*(?:=>|=|:)\s*(?:''[^''\s]{6,}''|\"[^\"\s]{6,}\")"
    ),
}


def matches_of(pattern: str, source: str = "texts", key: str = "path", text: str = "text") -> str:
    """(key, n, raw, head, line, rest): all matches with their position."""
    before = (
        "array_to_string(list_slice(ps, 1, n), '') || array_to_string(list_slice(ms, 1, n - 1), '')"
    )
    return f"""(
  SELECT {key}, n, raw, substring(body, 1, start - 1) AS head, cast(1 + length(before) - length(replace(before, {LF}, '')) AS INTEGER) AS line,
         substring(body, start) AS rest
  FROM (SELECT *, {before} AS before, 1 + length({before}) AS start
        FROM (SELECT {key}, body, ps, ms, unnest(ms) AS raw, generate_subscripts(ms, 1) AS n
              FROM (SELECT {key}, {text} AS body, string_split_regex({text}, '{pattern}') AS ps,
                           regexp_extract_all({text}, '{pattern}') AS ms FROM {source}
                    WHERE regexp_matches({text}, '{pattern}')) a) b) c)"""


def match_findings(patterns, show, source: str = "texts") -> str:
    return " UNION ALL ".join(
        f"SELECT '{scanner}' AS scanner, path AS file, line, '{rule}' AS rule,"
        f" '{severity}' AS severity, {show('raw')} AS match FROM {matches_of(p, source)}"
        for (scanner, rule, severity), p in patterns.items()
    )


# A user's own rules over whole texts: patterns of a rule, and words that cancel a match on any line it touches.
OWN_PATTERNS = {
    ("outside_call", "MEDIUM"): (r"(?i)(?:\bcurl_\w+\s*\()|(?:\b(?:shell_)?exec\s*\()", ""),
    ("request_read", "INFO"): (r"(?i)(?:\$_(?:GET|POST)\s*\[[^\]]*\])|(?:\$_COOKIE\b)", "htmlspecialchars|intval"),
    ("query_statement", "LOW"): (r"(?i)(?:->query\([^;]*)|(?:->execute\()", "some_long_table_name|delete"),
}


def own_findings(show) -> str:
    lines = r"regexp_extract(head, '[^\n]*$') || raw || regexp_extract(substring(rest, length(raw) + 1), '^[^\n]*')"
    return " UNION ALL ".join(
        f"SELECT 'own' AS scanner, path AS file, line, '{rule}' AS rule, '{severity}' AS severity,"
        f" {show('raw')} AS match FROM {matches_of(pattern)}"
        + (f" WHERE NOT regexp_matches(lower({lines}), '{veto}')" if veto else "")
        for (rule, severity), (pattern, veto) in OWN_PATTERNS.items()
    )


CALL = r"(?i)->\s*(?:query|execute)\s*\("
ASSIGN = r"(?i)\$([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.+?)\s*;"
# Calls and casts that make an assigned value count as sanitized.
RHS_SANITIZERS = (
    "(int)",
    "intval(",
    "filter_input(",
    "mysqli_real_escape_string(",
    "pg_escape_string(",
    "htmlspecialchars(",
    "htmlentities(",
    "urlencode(",
    "rawurlencode(",
)
RHS_SANITIZED = " OR ".join(f"contains(lower(rhs), '{t}')" for t in RHS_SANITIZERS)
ASSIGNED_CTE = (
    f"assigned AS (SELECT path, line_no, regexp_extract(line, '{ASSIGN}', 1) AS var,"
    f" regexp_extract(line, '{ASSIGN}', 2) AS rhs FROM lines)"
)
TAINTED_CTE = (
    f"tainted AS (SELECT DISTINCT path, var FROM assigned"
    rf" WHERE regexp_matches(rhs, '(?i){SG4}\b') AND NOT ({RHS_SANITIZED}))"
)
CALLS_CTE = f"""calls AS (
  SELECT path, line, CASE WHEN strpos(rest, ';') > 0 THEN substring(rest, 1, strpos(rest, ';') - 1)
                          ELSE substring(rest, 1, 600) END AS snippet
  FROM {matches_of(CALL)} m)"""
TAINTED_CALLS_CTE = rf"""tainted_calls AS (
  SELECT c.path, c.line, c.snippet FROM calls c
  WHERE regexp_matches(c.snippet, '(?i){SG4}\b')
     OR EXISTS (SELECT 1 FROM tainted t WHERE t.path = c.path AND contains(c.snippet, '$' || t.var)))"""


def span_prelude() -> str:
    return with_files(
        custom_cte("span"), texts_cte(), lines_cte(), ASSIGNED_CTE, TAINTED_CTE, CALLS_CTE, TAINTED_CALLS_CTE
    )


SPAN_SQLI = (
    "SELECT 'security' AS scanner, path AS file, line, 'sql_injection' AS rule,"
    f" 'CRITICAL' AS severity, {shortened('snippet')} AS match FROM tainted_calls"
)
BLOCK_SQLI = rf"""SELECT 'security' AS scanner, path AS file,
  cast(1 + length(head) - length(replace(head, {LF}, '')) AS INTEGER) AS line,
  'sql_injection' AS rule, 'CRITICAL' AS severity, {stripped('raw')} AS match
  FROM (SELECT path, raw, substring(text, 1, strpos(text, raw) - 1) AS head
        FROM (SELECT path, text,
                     regexp_extract(text, '(?is)(?:query|execute)\s*\(.*{SG3}\[') AS raw FROM texts) a
        WHERE raw <> '') b"""


def span_findings(credentials: bool = False) -> str:
    patterns = {**SPAN_PATTERNS, **(CREDENTIAL_PATTERNS if credentials else {})}
    return f"{SPAN_SQLI} UNION ALL {match_findings(patterns, shortened)}"


def block_findings(credentials: bool = False) -> str:
    patterns = {**BLOCK_PATTERNS, **(CREDENTIAL_PATTERNS if credentials else {})}
    return f"{BLOCK_SQLI} UNION ALL {match_findings(patterns, stripped)}"


# ------------------------------------------------------------- dead files

NAME = "regexp_extract(path, '[^/]*$')"
LOW = f"lower({NAME})"
# Suspicious parts of file names, in the order in which they are tried.
PARTS = (
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
FIRST_REASON = (
    f"CASE WHEN {LOW} IN ('wp-config.php', 'wp-config-sample.php', 'phpinfo.php', 'info.php', 'test.php')"
    f" THEN 'known dangerous filename: ' || {NAME}"
    f" WHEN regexp_matches({LOW}, 'demo-[a-z0-9]{{10,}}-') THEN 'demo file pattern: ' || {NAME}"
    rf" WHEN regexp_matches({LOW}, '^(?:x---|_|-)\w') THEN 'special prefix in filename: ' || {NAME} "
    + " ".join(
        f"WHEN contains({LOW}, '{p}') THEN 'suspicious substring ''{p}'' in filename: ' || {NAME}"
        for p in PARTS
    )
    + " END"
)


def _contains_any(parts) -> str:
    return "(" + " OR ".join(f"contains({LOW}, '{p}')" for p in parts) + ")"


def all_reasons(source: str) -> str:
    wp = (
        f"EXISTS (SELECT 1 FROM {source} r WHERE string_split(r.path, '/')[1]"
        " IN ('wp-includes', 'wp-admin', 'wp-settings.php'))"
    )
    return f"""concat_ws(';',
      CASE WHEN regexp_matches({LOW}, '^(x---|_|-)') THEN 'suspicious_prefix' END,
      CASE WHEN {_contains_any(['backup', '.bcakup', '.bak', ' bak', 'old', 'tmp', 'copy', 'test', 'debug'])}
           THEN 'backup_or_temp' END,
      CASE WHEN {_contains_any(['-old', '-last-', '123', '0ld'])} THEN 'suspicious_suffix' END,
      CASE WHEN regexp_matches({LOW}, 'demo-[a-z0-9]{{8,}}-') THEN 'demo_pattern' END,
      CASE WHEN {LOW} = 'wp-config.php' AND NOT {wp} THEN 'wp_config_outside_wordpress' END)"""


# File-name rules of the block profile.
NAME_RULES = (
    ("backup_extension", "INFO", r"device\.bcakup\.php"),
    ("backup_in_name", "LOW", r".*(backup|bak|old|tmp|copy|test|debug|-last-|\d{3,}|-old|0ld).*\.php$"),
    ("special_prefix", "MEDIUM", r"^(?:x--|_|-).*\.php$"),
    ("dangerous_demo", "HIGH", r"demo-[a-z0-9]{10,}.*\.php$"),
    ("misplaced_wp_config", "CRITICAL", r"wp-config\.php"),
)
DIR_OF = "regexp_replace({}, '/?[^/]*$', '')"
WP_DIRS_CTE = """wp_dirs AS (
  SELECT DISTINCT array_to_string(list_slice(ps, 1, i - 1), '/') AS dir
  FROM (SELECT string_split(path, '/') AS ps, unnest(range(1, len(string_split(path, '/')) + 1)) AS i
        FROM files) t
  WHERE ps[i] = 'wp-includes')"""


def line_names() -> str:
    return (
        "SELECT 'dead' AS scanner, path AS file, 0 AS line, 'dead_file' AS rule, 'MEDIUM' AS severity,"
        f" {FIRST_REASON} AS match FROM custom WHERE {FIRST_REASON} IS NOT NULL"
    )


def span_names(source: str = "files") -> str:
    return (
        "SELECT 'dead' AS scanner, path AS file, 1 AS line, 'dead_or_backup_file' AS rule,"
        f" 'LOW' AS severity, match FROM (SELECT path, {all_reasons(source)} AS match FROM {source}"
        f" WHERE NOT {VENDOR['span']}) t WHERE match <> ''"
    )


def block_names() -> str:
    parts = []
    for rule, severity, pattern in NAME_RULES:
        extra = ""
        if rule == "misplaced_wp_config":
            extra = f" AND {DIR_OF.format('path')} NOT IN (SELECT dir FROM wp_dirs)"
        parts.append(
            f"SELECT 'dead' AS scanner, path AS file, 0 AS line, 'deadfile_{rule}' AS rule,"
            f" '{severity}' AS severity, 'Filename matches pattern: {pattern}' AS match FROM custom"
            f" WHERE regexp_matches({NAME}, '(?i)^(?:{pattern})'){extra}"
        )
    return " UNION ALL ".join(parts)


def names_sql(profile: str) -> str:
    return {"line": line_names, "span": span_names, "block": block_names}[profile]()


def findings_prelude(profile: str) -> str:
    if profile == "line":
        return line_prelude()
    if profile == "span":
        return span_prelude()
    return with_files(custom_cte("block"), texts_cte(), WP_DIRS_CTE)


def content_sql(profile: str) -> str:
    return {
        "line": line_findings,
        "span": lambda: span_findings(True),
        "block": lambda: block_findings(True),
    }[profile]()


def findings_sql(profile: str) -> str:
    return f"{content_sql(profile)} UNION ALL {names_sql(profile)}"


def weight(expr: str = "severity") -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in ORDER.items()) + " ELSE 0 END)"


FINDING = "scanner, file, line, rule, severity, match"


# ---------------------------------------------------------- include graph

INC = r"\b(?:include|require)(?:_once)?"
LINE_LITERAL = rf"(?i){INC}\s*\(?\s*{Q}([^''\"]+){Q}"
LINE_DIR = rf"(?i){INC}\s*\(?\s*(?:dirname\s*\(\s*__FILE__\s*\)|__DIR__)\s*\.\s*{Q}([^''\"]+){Q}"
SPAN_STMT = rf"(?i){INC}\b\s*(?:\(\s*)?([^;]+?)\s*\)?\s*;"
BLOCK_LITERAL = rf"(?i)(?:include|require)(?:_once)?\s*\(?\s*{Q}([^''\"]+){Q}"


def _all(source: str, column: str, pattern: str) -> str:
    return f"SELECT path AS src, unnest(regexp_extract_all({column}, '{pattern}', 1)) AS raw FROM {source}"


def raw_sql(form: str) -> str:
    if form == "literal":
        return _all("lines", "line", LINE_LITERAL)
    if form == "dir":
        return _all("lines", "line", LINE_DIR)
    if form == "block":
        return _all("texts", "text", BLOCK_LITERAL)
    arguments = f"SELECT src, {stripped('raw')} AS arg FROM ({_all('lines', 'line', SPAN_STMT)}) a"
    return (
        f"SELECT src, substring(arg, 2, length(arg) - 2) AS raw FROM ({arguments}) b"
        " WHERE length(arg) > 2 AND arg[1] = arg[-1] AND arg[1] IN (chr(39), '\"')"
    )


def includes_sql(profile: str) -> str:
    raws = {
        "line": f"{raw_sql('literal')} UNION ALL {raw_sql('dir')}",
        "span": raw_sql("stmt"),
        "block": raw_sql("block"),
    }[profile]
    return f"SELECT DISTINCT src, raw FROM ({raws}) i"


def folded(expr: str, rounds: int = 6) -> str:
    out = f"replace({expr}, '/./', '/')"
    for _ in range(rounds):
        out = rf"regexp_replace({out}, '(^|/)(?:[^/.]|\.[^/.])[^/]*/\.\./', '\1')"
    return out


EXISTING_CTE = """existing AS (
  SELECT DISTINCT path FROM files
  UNION SELECT DISTINCT array_to_string(list_slice(ps, 1, i), '/') FROM (
    SELECT string_split(path, '/') AS ps, unnest(range(0, len(string_split(path, '/')))) AS i
    FROM files) t)"""


def places_cte(profile: str) -> str:
    here = f"ltrim({DIR_OF.format('src')} || '/' || raw, '/')"
    top = "ltrim(raw, '/')"
    local = "NOT starts_with(raw, '/')"
    if profile == "block":
        rows = [(0, here, local)]
    elif profile == "line":
        rows = [(0, here, local), (1, top, "true")]
    else:
        bare = r"NOT regexp_matches({}, '^(?:.*/)?[^/]+\.[^./]+$')"
        url = "NOT contains(raw, '://')"
        rows = [
            (0, here, f"{local} AND {url}"),
            (1, f"{here} || '.php'", f"{local} AND {url} AND {bare.format(here)}"),
            (2, top, url),
            (3, f"{top} || '.php'", f"{url} AND {bare.format(top)}"),
        ]
    return "places AS (" + " UNION ALL ".join(
        f"SELECT src, raw, {prio} AS prio, {folded(place)} AS place FROM includes WHERE {test}"
        for prio, place, test in rows
    ) + ")"


def graph_ctes(profile: str) -> list[str]:
    known = "custom" if profile == "block" else "existing"
    return [
        f"includes AS ({includes_sql(profile)})",
        EXISTING_CTE,
        places_cte(profile),
        "resolved AS (SELECT src, raw, arg_min(place, prio) AS dst FROM places"
        f" WHERE place IN (SELECT path FROM {known}) GROUP BY src, raw)",
        "edges AS (SELECT DISTINCT src, dst FROM resolved WHERE dst IN (SELECT path FROM custom))",
        "degrees AS (SELECT path AS node, count(src) AS in_degree"
        " FROM custom LEFT JOIN edges ON dst = path GROUP BY path)",
    ]


def graph_prelude(profile: str) -> str:
    return with_files(custom_cte(profile), texts_cte(), lines_cte(), *graph_ctes(profile))


CYCLES_CTE = """walks AS (
  SELECT src AS start, dst AS node, CASE WHEN src = dst THEN [src] ELSE [src, dst] END AS path,
         src = dst AS closed
  FROM edges WHERE dst >= src
  UNION ALL
  SELECT w.start, e.dst, CASE WHEN e.dst = w.start THEN w.path ELSE list_append(w.path, e.dst) END,
         e.dst = w.start
  FROM walks w JOIN edges e ON w.node = e.src
  WHERE NOT w.closed AND e.dst >= w.start AND (e.dst = w.start OR NOT list_contains(w.path, e.dst))),
cycles AS (SELECT cast(len(path) AS INTEGER) AS length, array_to_string(path, '|') AS cycle
           FROM walks WHERE closed)"""

ENTRY = {
    "line": "false",
    "span": f"lower({NAME.replace('path', 'node')}) IN ('index.php', 'main.php', 'app.php', 'bootstrap.php')",
    "block": "contains(node, 'index.php')",
}


def cycles_prelude(profile: str) -> str:
    return with_files(custom_cte(profile), texts_cte(), lines_cte(), *graph_ctes(profile), CYCLES_CTE)


# --------------------------------------------------------------- registry


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    for p in ("line", "span", "block"):
        sql[f"filter_vendor_{p}"] = f"{with_files()} SELECT path FROM files WHERE NOT {VENDOR[p]}"
        sql[f"file_stats_{p}"] = (
            f"{with_files()} SELECT count(*) FILTER (NOT {VENDOR[p]}) AS custom_files,"
            f" count(*) FILTER ({VENDOR[p]}) AS vendor_files, count(*) AS total_files"
            f" FROM files WHERE {PHP[p]}"
        )
        inside = VENDOR[p].replace("path", "substring(path, 10)")
        outside = (
            f"NOT starts_with(path, '/srv/app/') AND NOT {VENDOR[p]} OR" if p == "span" else ""
        )
        sql[f"filter_outside_root_{p}"] = (
            f"{with_files()} SELECT path FROM (SELECT '/srv/' || path AS path FROM files) t"
            f" WHERE {outside} (starts_with(path, '/srv/app/') AND NOT {inside})"
        )
        sql[f"include_nodes_{p}"] = f"{with_files(custom_cte(p))} SELECT path FROM custom"
        sql[f"resolve_includes_{p}"] = (
            f"{graph_prelude(p)} SELECT src, raw, dst, dst IN (SELECT path FROM custom) AS is_node FROM resolved"
        )
        sql[f"include_edges_{p}"] = f"{graph_prelude(p)} SELECT src, dst FROM edges"
        sql[f"in_degree_{p}"] = f"{graph_prelude(p)} SELECT node, in_degree FROM degrees"
        sql[f"top_hubs_{p}"] = (
            f"{graph_prelude(p)} SELECT node, in_degree FROM degrees ORDER BY in_degree DESC, node LIMIT 10"
        )
        sql[f"orphan_files_{p}"] = (
            f"{graph_prelude(p)} SELECT node FROM degrees WHERE in_degree = 0 AND NOT {ENTRY[p]}"
        )
        sql[f"graph_stats_{p}"] = (
            f"{graph_prelude(p)} SELECT (SELECT count(*) FROM custom) AS nodes,"
            " (SELECT count(*) FROM edges) AS edges"
        )
        sql[f"include_cycles_{p}"] = f"{cycles_prelude(p)} SELECT length, cycle FROM cycles"
        sql[f"severity_badge_{p}"] = _badges(p)
        sql[f"scan_security_all_{p}"] = f"{findings_prelude(p)} " + {
            "line": line_findings(lambda s, r, v: s == "security"),
            "span": span_findings(),
            "block": block_findings(),
        }[p]
        for rule in (
            "sql_injection eval_usage xss_direct_echo dynamic_include shell_exec open_redirect".split()
        ):
            sql[f"sec_{rule}_{p}"] = _one_rule(rule, p)
    sql["filter_vendor_hidden_alias"] = (
        f"{with_files()} SELECT path FROM files WHERE {VENDOR['span']} AND NOT {VENDOR['line']}"
    )
    for p in ("line", "block"):
        sql[f"filter_extension_{p}"] = f"{with_files()} SELECT path FROM files WHERE {PHP[p]}"
        floor = f"{weight()} >= 4"
        dead = names_sql(p) if p == "line" else f"SELECT * FROM ({names_sql(p)}) d WHERE {floor}"
        sql[f"filter_min_severity_{p}"] = (
            f"{findings_prelude(p)} SELECT * FROM ({content_sql(p)}) f WHERE {floor} UNION ALL {dead}"
        )
        order = f"{weight()} DESC, " if p == "line" else ""
        sql[f"sort_findings_{p}"] = (
            f"{findings_prelude(p)} SELECT row_number() OVER (ORDER BY {order}file, line, rule, match) AS place, *"
            f" FROM ({findings_sql(p)}) f"
        )
    sql["union_findings"] = f"{findings_prelude('block')} {findings_sql('block')}"
    sql["sanitizer_veto"] = (
        f"{line_prelude()} SELECT path, line_no, line FROM lines WHERE contains(line, '$_') AND ({SANITIZED})"
    )
    sql["sanitized_rhs"] = (
        f"{span_prelude()} SELECT path, line_no, rhs, ({RHS_SANITIZED}) AS sanitized FROM assigned"
        rf" WHERE regexp_matches(rhs, '(?i){SG4}\b')"
    )
    sql["select_scanners"] = f"{with_files()} {names_sql('span')}"
    sql["relpath"] = (
        f"{with_files()} SELECT path,"
        " CASE WHEN starts_with(path, '/srv/app/') THEN substring(path, 10) ELSE path END AS relpath,"
        " CASE WHEN starts_with(path, '/srv/app/') THEN substring(path, 10)"
        " ELSE regexp_extract(path, '[^/]*$') END AS display"
        " FROM (SELECT '/srv/' || path AS path FROM files) t"
    )
    sql["split_lines"] = f"{line_prelude()} SELECT path, line_no, line FROM lines"
    sql["normalize_newlines"] = (
        f"{with_files(texts_cte('files'))} SELECT path,"
        " length(content) - length(replace(content, chr(13), '')) AS returns_before,"
        " length(text) - length(replace(text, chr(13), '')) AS returns_after,"
        f" length(text) - length(replace(text, {LF}, '')) AS feeds_after"
        " FROM files JOIN texts USING (path)"
    )
    link = r"</(?:p|li|h1)>\s*<"
    sql["offset_to_line"] = (
        f"SELECT page_id, cast(n - 1 AS INTEGER) AS match_no, line, raw AS match FROM "
        f"{matches_of(link, 'pages', 'page_id', 'html')} m"
    )
    sql["shorten"] = f"SELECT doc_id, {shortened('text')} AS short FROM documents"
    cell = "replace(match, '|', '\\|')"
    sql["md_cell"] = (
        f"{line_prelude()} SELECT file, line, rule, substring({cell}, 1, 80)"
        " || CASE WHEN length(match) > 80 THEN chr(8230) ELSE '' END AS cell"
        f" FROM ({line_findings(lambda s, r, v: s == 'security')}) f"
    )
    sql["finding_to_record"] = f"{span_prelude()} SELECT file, line, rule, severity, match FROM ({span_findings()}) f"
    sql["finding_display"] = (
        f"{line_prelude()} SELECT '[' || severity || '] ' || file || ':' || line || ' (' || rule || '): '"
        " || CASE WHEN contains(match, chr(39)) AND NOT contains(match, '\"') THEN '\"' || match || '\"'"
        " ELSE chr(39) || replace(match, chr(39), '\\' || chr(39)) || chr(39) END AS display"
        f" FROM ({line_findings(lambda s, r, v: s == 'security')}) f"
    )
    sql["tainted_vars"] = f"{span_prelude()} SELECT path, var FROM tainted"
    sql["query_calls"] = f"{span_prelude()} SELECT path, line, snippet FROM calls"
    sql["sqli_taint"] = f"{span_prelude()} SELECT path, line, snippet FROM tainted_calls"
    for key, rule in (
        ("cred_hardcoded_db_password", "hardcoded_db_password"),
        ("cred_define_secret", "define_secret"),
        ("cred_hardcoded_assignment", "hardcoded_assignment"),
        ("cred_base64_key", "base64_encoded_key"),
    ):
        sql[key] = f"{line_prelude()} {line_findings(lambda s, r, v, rule=rule: r == rule)}"
    sql["scan_credentials_span"] = f"{text_prelude('span')} {match_findings(CREDENTIAL_PATTERNS, shortened)}"
    sql["scan_credentials_block"] = f"{text_prelude('block')} {match_findings(CREDENTIAL_PATTERNS, stripped)}"
    documents = "WITH texts AS (SELECT cast(doc_id AS VARCHAR) AS path, text FROM documents)"
    plain = r"(?i)\w*(?:key|secret|token|password)\w*\s*=\s*" + LITERAL
    sql["cred_assignment_documents"] = (
        documents + " " + match_findings({("credential", "hardcoded_assignment", "HIGH"): plain}, shortened)
    )
    candidates = r"regexp_matches(lower(path), '\.(py|php|env)$')"
    leak_texts = with_files(
        f"candidates AS (SELECT * FROM files WHERE {candidates})", texts_cte("candidates")
    )
    allowed = "NOT regexp_matches(text, 'FAKE|PLACEHOLDER|EXAMPLE')"
    sql["leak_patterns"] = f"{leak_texts} {match_findings(LEAK_PATTERNS, shortened)}"
    sql["leak_allowlist"] = (
        f"{leak_texts}, checked AS (SELECT * FROM texts WHERE {allowed})"
        f" {match_findings(LEAK_PATTERNS, shortened, 'checked')}"
    )
    sql["leak_patterns_documents"] = (
        f"{documents}, checked AS (SELECT * FROM texts WHERE {allowed})"
        f" {match_findings(LEAK_PATTERNS, shortened, 'checked')}"
    )
    sql["custom_rules"] = (
        f"{line_prelude()} SELECT 'own' AS scanner, path AS file, line_no AS line, 'curl_call' AS rule,"
        rf" 'LOW' AS severity, {stripped('line')} AS match FROM lines WHERE {_line(r'\bcurl_\w+\s*\(')}"
        " UNION ALL SELECT 'own', path, line_no, 'cookie_read', 'INFO',"
        rf" {stripped('line')} FROM lines WHERE {_line(r'\$_COOKIE\b')}"
        " AND NOT contains(lower(line), 'htmlspecialchars')"
    )
    sql["dead_first_reason"] = f"{with_files(custom_cte('line'))} {line_names()}"
    sql["dead_all_reasons"] = f"{with_files()} {span_names()}"
    sql["dead_multi_rule"] = f"{with_files(custom_cte('block'), WP_DIRS_CTE)} {block_names()}"
    lib = "lib AS (SELECT substring(path, 5) AS path FROM files WHERE starts_with(path, 'lib/'))"
    sql["wp_context_root"] = f"{with_files(lib)} {span_names('lib')}"
    sql["wp_context_sibling"] = f"{with_files(WP_DIRS_CTE)} SELECT dir FROM wp_dirs"
    sql["extract_includes_line"] = f"{line_prelude()} {raw_sql('literal')}"
    sql["extract_includes_dir"] = f"{line_prelude()} {raw_sql('dir')}"
    sql["extract_includes_stmt"] = f"{line_prelude('span')} {raw_sql('stmt')}"
    sql["extract_includes_block"] = f"{text_prelude('block')} {raw_sql('block')}"
    joined = f"{DIR_OF.format('src')} || '/./' || ltrim(raw, '/')"
    sql["normalize_path"] = (
        f"{line_prelude()} SELECT src, raw, rtrim({folded(joined)}, '/') AS folded FROM ({includes_sql('line')}) i"
    )
    sql["edge_lookup"] = f"{graph_prelude('line')} SELECT src, dst FROM edges WHERE dst = '{HUB}'"
    sql["edge_successors"] = (
        f"{graph_prelude('line')} SELECT dst AS node FROM edges WHERE src = '{SUCCESSORS_OF}'"
    )
    sql["edge_has_edge"] = (
        f"{graph_prelude('line')} SELECT count(*) > 0 AS has_edge FROM edges"
        f" WHERE src = '{SUCCESSORS_OF}' AND dst = '{HUB}'"
    )
    levels = "(VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity)"
    for p, source in (
        ("line", f"SELECT * FROM ({line_findings()}) x WHERE {weight()} >= 4"),
        ("span", findings_sql("span")),
    ):
        sql[f"count_by_severity_{p}"] = (
            f"{findings_prelude(p)} SELECT s.severity, count(f.rule) AS findings FROM {levels}"
            f" LEFT JOIN ({source}) f ON f.severity = s.severity GROUP BY s.severity"
        )
    sql["count_by_scanner"] = (
        f"{findings_prelude('block')}, f AS ({findings_sql('block')})"
        " SELECT scanner, count(*) AS findings FROM f GROUP BY scanner"
        " UNION ALL SELECT 'total', count(*) FROM f"
    )
    sql["scanner_finding_counts"] = (
        f"{span_prelude()} SELECT scanner, count(*) AS findings FROM ({findings_sql('span')}) f"
        f" WHERE {weight()} >= 3 GROUP BY scanner"
    )
    sql["limit_with_remainder_orphans"] = (
        f"{graph_prelude('line')}, o AS (SELECT node FROM degrees WHERE in_degree = 0)"
        " SELECT cast(row_number() OVER (ORDER BY node) AS INTEGER) AS rank, node,"
        " (SELECT count(*) FROM o) AS total, greatest((SELECT count(*) FROM o) - 20, 0) AS more"
        " FROM o ORDER BY node LIMIT 20"
    )
    sql["limit_with_remainder_cycles"] = (
        f"{cycles_prelude('span')} SELECT cast(row_number() OVER (ORDER BY length, cycle) AS INTEGER) AS rank,"
        " length, cycle, (SELECT count(*) FROM cycles) AS total FROM cycles ORDER BY length, cycle LIMIT 10"
    )
    sql["dedup"] = f"{span_prelude()} SELECT DISTINCT file, rule FROM ({span_findings()}) f"
    both = f"WITH RECURSIVE {files_cte()}, {files_cte('before', SNAPSHOT_DATE)}"
    changed = "changed AS (SELECT f.* FROM files f LEFT JOIN before b USING (path) WHERE b.content IS DISTINCT FROM f.content)"
    sql["changed_files"] = f"{both}, {changed} SELECT path, content FROM changed"
    sql["changed_paths"] = (
        f"{both} SELECT f.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS status"
        " FROM files f LEFT JOIN before b ON b.path = f.path WHERE b.content IS DISTINCT FROM f.content"
    )
    sql["new_findings"] = ", ".join(
        [
            both,
            custom_cte("line"),
            texts_cte(),
            lines_cte(),
            custom_cte("line", "before", "old_custom"),
            texts_cte("old_custom", "old_texts"),
            lines_cte("old_texts", "old_lines"),
            f"old AS ({line_findings(source='old_lines')})",
        ]
    ) + (
        f" SELECT {FINDING} FROM ({line_findings()}) f WHERE NOT EXISTS"
        " (SELECT 1 FROM old WHERE old.file = f.file AND old.rule = f.rule AND old.match = f.match)"
    )
    sql["gate"] = (
        f"{both}, {changed}, candidates AS (SELECT * FROM changed WHERE {candidates}),"
        f" {texts_cte('candidates')}, checked AS (SELECT * FROM texts WHERE {allowed})"
        " SELECT count(*) AS blocking, count(*) > 0 AS blocked FROM"
        f" ({match_findings(LEAK_PATTERNS, shortened, 'checked')}) f WHERE {weight()} >= 4"
    )
    sql.update(_report_sql())
    for p in ("line", "span", "block"):
        sql[f"scan_source_files_{p}"] = (
            f"{with_files(custom_cte(p))} SELECT path, sha256(content) AS digest FROM custom"
        )
    mark = {"line": "content || 'caf' || chr(65533) || ';'", "span": "content || 'caf;'", "block": "NULL"}
    for p, broken in mark.items():
        decoded = f"decoded AS (SELECT path, CASE WHEN length(content) % 3 = 0 THEN {broken} ELSE content END AS content FROM files)"
        sql[f"decode_text_{p}"] = (
            f"{with_files(decoded, texts_cte('decoded'))} SELECT path, text FROM texts WHERE text IS NOT NULL"
        )
    sql["scan_all_nonvendor_files"] = (
        f"{with_files()} SELECT path, strlen(content) AS length FROM files WHERE NOT {VENDOR['span']}"
    )
    sql["scan_unpruned_files"] = (
        f"{with_files()} SELECT path, strlen(content) AS length FROM files WHERE {PHP['line']}"
    )
    sql["scan_tree_findings"] = f"{line_prelude()} {findings_sql('line')}"
    readable = "readable AS (SELECT * FROM files WHERE length(content) % 5 <> 0)"
    for p in ("line", "span", "block"):
        strict = " OR length(content) % 3 = 0" if p == "block" else ""
        sql[f"skipped_files_{p}"] = (
            f"{with_files(custom_cte(p))} SELECT path, CASE WHEN length(content) % 5 = 0 THEN 'unreadable'"
            f" ELSE 'not valid UTF-8' END AS reason FROM custom WHERE length(content) % 5 = 0{strict}"
        )
        taints = [ASSIGNED_CTE, TAINTED_CTE, CALLS_CTE, TAINTED_CALLS_CTE] if p == "span" else []
        sql[f"one_pass_{p}"] = (
            with_files(readable, custom_cte(p, "readable"), texts_cte(), lines_cte(), *taints)
            + f" SELECT 'finding' AS kind, file, line, rule, severity, match FROM ({content_sql(p)}) f"
            f" UNION ALL SELECT 'include', src, NULL, NULL, NULL, raw FROM ({includes_sql(p)}) i"
            " UNION ALL SELECT 'skipped', path, NULL, 'unreadable', NULL, NULL FROM files"
            f" WHERE {PHP[p]} AND NOT {VENDOR[p]} AND length(content) % 5 = 0"
        )
    for p, show in (("span", shortened), ("block", stripped)):
        sql[f"custom_rules_{p}"] = f"{text_prelude(p)} {own_findings(show)}"
    sql["changed_tree_files"] = (
        f"{both}, {changed}, {custom_cte('line', 'changed')} SELECT path, sha256(content) AS digest FROM custom"
    )
    sql["stream_scan_files"] = f"{line_prelude()} {line_findings()}"
    line_rows = (
        f"WITH lines AS (SELECT {corpus.path_sql('o_custkey', corpus.DUCKDB)} AS path,"
        f" o_orderkey AS line_no, {corpus.template_sql('o_orderkey', corpus.DUCKDB)} AS line FROM orders)"
    )
    sql["stream_scan"] = f"{line_rows} {line_findings(lambda s, r, v: s == 'security')}"
    sql["stream_scan_documents"] = sql["leak_patterns_documents"]
    return sql


def _rows(section: int, text: str, source: str = "") -> str:
    return f"SELECT {section} AS section, {text} AS text {source}"


def _fixed(section: int, *lines: str) -> str:
    values = ", ".join("('" + x.replace("'", "''") + "')" for x in lines)
    return f"SELECT {section} AS section, v.t AS text FROM (VALUES {values}) v(t)"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


LEVELS = "(VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity)"


def _summary_rows(profile: str) -> str:
    counted = "WHERE scanner <> 'dead'" if profile == "line" else ""
    rule = "|----------|-------|" if profile == "line" else "|---|---:|"
    return _union(
        _fixed(2, "## Summary", "", "| Severity | Count |", rule, ""),
        _rows(
            2,
            f"'| ' || {_badge(profile, 's.severity')} || ' | ' || count(f.rule) || ' |'",
            f"FROM {LEVELS} LEFT JOIN (SELECT * FROM findings {counted}) f"
            " ON f.severity = s.severity GROUP BY s.severity",
        ),
    )


def _stats_rows(profile: str) -> str:
    custom = f"count(*) FILTER (NOT {VENDOR[profile]})"
    vendor = f"count(*) FILTER ({VENDOR[profile]})"
    source = f"FROM files WHERE {PHP[profile]}"
    if profile == "span":
        return _union(
            _rows(1, f"'- Custom PHP files: `' || {custom} || '`'", source),
            _rows(1, f"'- Vendor PHP files (excluded): `' || {vendor} || '`'", source),
            _fixed(1, ""),
        )
    return _union(
        _fixed(3, "## File Statistics", "", ""),
        _rows(3, f"'- **Custom PHP files scanned:** ' || {custom}", source),
        _rows(3, f"'- **Vendor files excluded:** ' || {vendor}", source),
        _rows(3, "'- **Total PHP files found:** ' || count(*)", source),
    )


def _finding_rows(profile: str) -> str:
    badge = _badge(profile, "severity")
    if profile == "line":
        cell = (
            "substring(replace(match, '|', '\\|'), 1, 80)"
            " || CASE WHEN length(match) > 80 THEN chr(8230) ELSE '' END"
        )
        row = (
            f"'| ' || {badge} || ' | `' || file || '` | ' || line || ' | `' || rule || '` | `' || {cell} || '` |'"
        )
        table = ("| Severity | File | Line | Rule | Match |", "|----------|------|------|------|-------|")
        return _union(
            _fixed(4, "## Credential & Secret Findings", "", *table, ""),
            _rows(4, row, "FROM findings WHERE scanner = 'credential'"),
            _fixed(5, "## Security Vulnerability Findings", "", *table, ""),
            _rows(5, row, "FROM findings WHERE scanner = 'security'"),
        )
    if profile == "span":
        return _union(
            _fixed(8, "## Findings", ""),
            _rows(
                8,
                f"'- ' || {badge} || ' [`' || file || ':' || line || '`](' || file || '#L' || line || ') **'"
                " || rule || '** (' || replace(scanner, 'dead', 'deadfile') || '): `' || match || '`'",
                "FROM findings",
            ),
        )
    line = "CASE WHEN line > 0 THEN '- **Line:** ' || line || chr(10) ELSE '' END"
    return _union(
        _rows(
            5,
            "'## ' || upper(scanner[1]) || substring(scanner, 2) || ' Scanner Scanner' || chr(10)",
            "FROM (SELECT DISTINCT scanner FROM findings) f",
        ),
        _rows(
            5,
            f"'### `' || rule || '`' || chr(10) || chr(10) || '- **Severity:** ' || severity || ' ' || {badge}"
            f" || chr(10) || '- **File:** `' || file || '`' || chr(10) || {line} || '- **Match:**' || chr(10)"
            " || '```php' || chr(10) || match || chr(10) || '```' || chr(10)",
            "FROM findings",
        ),
    )


HUBS_CTE = "hubs AS (SELECT node, in_degree FROM degrees ORDER BY in_degree DESC, node LIMIT 10)"
SIZES_CTE = (
    "sizes AS (SELECT (SELECT count(*) FROM custom) AS nodes, (SELECT count(*) FROM edges) AS edges,"
    " (SELECT count(*) FROM cycles) AS cycles)"
)


def _orphans_cte(profile: str) -> str:
    return f"orphans AS (SELECT node FROM degrees WHERE in_degree = 0 AND NOT {ENTRY[profile]})"


def _graph_rows(profile: str) -> str:
    if profile == "span":
        return _union(
            _fixed(6, "## Dependency Graph", "", "- Top hubs (in-degree):", ""),
            _rows(6, "'- Graph: `' || nodes || '` nodes, `' || edges || '` edges'", "FROM sizes"),
            _rows(6, "'  - `' || node || '`: `' || in_degree || '`'", "FROM hubs"),
            _rows(6, "'- Cycles detected: `' || cycles || '`'", "FROM sizes WHERE cycles > 0"),
        )
    if profile == "block":
        return _union(
            _rows(6, "'## Dependency Analysis Scanner' || chr(10)"),
            _fixed(6, "- **Top 5 Hubs (most included files):**", ""),
            _rows(
                6,
                "'- **Orphan Files (not included by any other file):**'",
                "FROM orphans HAVING count(*) > 0",
            ),
            _rows(6, "'- **Graph:** ' || nodes || ' nodes, ' || edges || ' edges'", "FROM sizes"),
            _rows(6, "'- **Cycles Detected:** ' || cycles", "FROM sizes WHERE cycles > 0"),
            _rows(6, "'  - `' || node || '` (score: ' || in_degree || ')'", "FROM hubs"),
            _rows(6, "'  - `' || node || '`'", "FROM orphans"),
        )
    return _union(
        _fixed(6, "## Dependency Analysis", ""),
        _fixed(6, "", "### Top Included Files (Hubs)", "", "| File | In-degree |", "|------|-----------|"),
        _fixed(6, ""),
        *[_rows(6, "''", "FROM sizes WHERE cycles > 0") for _ in range(2)],
        *[_rows(6, "''", "FROM orphans HAVING count(*) > 0") for _ in range(2)],
        _rows(6, "'- **Nodes (files):** ' || nodes", "FROM sizes"),
        _rows(6, "'- **Edges (include relationships):** ' || edges", "FROM sizes"),
        _rows(6, "'| `' || node || '` | ' || in_degree || ' |'", "FROM hubs"),
        _rows(6, "'### Circular Dependencies (' || cycles || ' detected)'", "FROM sizes WHERE cycles > 0"),
        _rows(
            6,
            "rank || '. `' || replace(cycle, '|', '` ' || chr(8594) || ' `') || '`'",
            "FROM (SELECT cycle, row_number() OVER (ORDER BY length, string_split(cycle, '|')) AS rank"
            " FROM cycles) c WHERE rank <= 10",
        ),
        _rows(
            6,
            "'### Orphaned Files (' || count(*) || ' files with no incoming includes)'",
            "FROM orphans HAVING count(*) > 0",
        ),
        _rows(6, "'- `' || node || '`'", "FROM (SELECT node FROM orphans ORDER BY node LIMIT 20) o"),
        _rows(6, "'- _...and ' || (count(*) - 20) || ' more_'", "FROM orphans HAVING count(*) > 20"),
    )


def _floor_cte(profile: str) -> str:
    floor = f"{weight()} >= 4"
    dead = names_sql(profile)
    if profile != "line":
        dead = f"SELECT * FROM ({dead}) d WHERE {floor}"
    return f"findings AS (SELECT * FROM ({content_sql(profile)}) f WHERE {floor} UNION ALL {dead})"


def _dead_rows(source: str) -> str:
    return _union(
        _fixed(7, "## Dead / Backup File Findings", "", "| File | Reason |", "|------|--------|", ""),
        _rows(7, "'| `' || file || '` | ' || match || ' |'", f"FROM ({source}) d"),
    )


def _report_sql() -> dict[str, str]:
    sql = {}
    for p in ("line", "span", "block"):
        prelude = f"{findings_prelude(p)}, {_floor_cte(p)}"
        graph = f"{cycles_prelude(p)}, {HUBS_CTE}, {SIZES_CTE}, {_orphans_cte(p)}"
        sql[f"report_findings_{p}"] = f"{prelude} {_finding_rows(p)}"
        sql[f"report_graph_{p}"] = f"{graph} {_graph_rows(p)}"
        if p != "block":
            sql[f"report_summary_{p}"] = f"{prelude} {_summary_rows(p)}"
            sql[f"report_file_stats_{p}"] = f"{with_files()} {_stats_rows(p)}"
    block = f"{findings_prelude('block')}, {_floor_cte('block')}"
    sql["report_summary_block"] = block + " " + _union(
        _fixed(2, "## Summary", "", "| Scanner | Findings |", "|---------|----------|", "", "| Dependency Analysis | 5 |"),
        _rows(
            2,
            "'| ' || t || ' Scanner | ' || count(f.rule) || ' |'",
            "FROM (VALUES ('security', 'Security'), ('credential', 'Credential'), ('dead', 'Dead')) s(n, t)"
            " LEFT JOIN findings f ON f.scanner = s.n GROUP BY t",
        ),
        _rows(2, "'| **Total** | **' || (count(*) + 5) || '** |'", "FROM findings"),
    )
    sql["report_dead_files"] = f"{with_files(custom_cte('line'))} {_dead_rows(line_names())}"
    sql["report_empty"] = _union(
        _fixed(4, "## Credential & Secret Findings", "", "_No credential findings._", ""),
        _fixed(5, "## Security Vulnerability Findings", "", "_No security findings._", ""),
        _fixed(8, "## Findings", "", "_No findings._", ""),
        _fixed(7, "## Dead / Backup File Findings", "", "_No dead/backup files found._", ""),
        _rows(4, "chr(9989) || ' No issues found.'"),
    )
    span = ", ".join(
        [
            span_prelude(),
            _floor_cte("span"),
            *graph_ctes("span"),
            CYCLES_CTE,
            HUBS_CTE,
            SIZES_CTE,
            _orphans_cte("span"),
        ]
    )
    parts = _union(
        _fixed(0, "# Source risk report: spans", "", "- Root: `/srv/project`"),
        _stats_rows("span"),
        _summary_rows("span"),
        _graph_rows("span"),
        _finding_rows("span"),
    )
    sql["write_markdown"] = f"{span} SELECT text FROM ({parts}) r"
    sql["write_json"] = f"{line_prelude()}, {_floor_cte('line')} SELECT {FINDING} FROM findings"
    sql["write_json_document"] = (
        f"{cycles_prelude('line')}, {_floor_cte('line')}, {SIZES_CTE} SELECT '2000-01-01T00:00:00' AS generated_at,"
        f" '/srv/project' AS root, (SELECT count(*) FROM files WHERE {PHP['line']}) AS total_files, nodes, edges, cycles,"
        " file, line, rule, severity, match FROM findings, sizes"
    )
    sql["write_json_tables"] = (
        f"{graph_prelude('span')}, {_orphans_cte('span')} SELECT (SELECT count(*) FROM custom) AS nodes,"
        " (SELECT count(*) FROM edges) AS edges,"
        f" (SELECT count(*) FROM files WHERE {PHP['span']}) AS total_files,"
        " (SELECT count(*) FROM orphans) AS orphans"
    )
    return sql


def _one_rule(rule: str, profile: str) -> str:
    if profile == "line":
        return f"{line_prelude()} {line_findings(lambda s, r, v: r == rule)}"
    patterns, show, special = {
        "span": (SPAN_PATTERNS, shortened, SPAN_SQLI),
        "block": (BLOCK_PATTERNS, stripped, BLOCK_SQLI),
    }[profile]
    if rule == "sql_injection":
        return f"{findings_prelude(profile)} {special}"
    chosen = {k: v for k, v in patterns.items() if k[1] == rule}
    return f"{text_prelude(profile)} {match_findings(chosen, show)}"


def _badge(profile: str, severity: str) -> str:
    if profile == "span":
        return f"'`' || {severity} || '`'"
    if profile == "block":
        color = (
            f"CASE {severity} WHEN 'HIGH' THEN 'orange' WHEN 'MEDIUM' THEN 'yellow'"
            " WHEN 'LOW' THEN 'blue' WHEN 'INFO' THEN 'blue' ELSE 'red' END"
        )
        return (
            f"'![' || {severity} || '](https://img.shields.io/badge/severity-' || {severity}"
            f" || '-' || {color} || ')'"
        )
    return (
        f"CASE {severity} WHEN 'CRITICAL' THEN chr(128308) WHEN 'HIGH' THEN chr(128992)"
        f" WHEN 'MEDIUM' THEN chr(128993) WHEN 'LOW' THEN chr(128309) ELSE chr(9898) END"
        f" || ' ' || {severity}"
    )


def _badges(profile: str) -> str:
    extra = [WP_DIRS_CTE] if profile == "block" else []
    return (
        f"{with_files(custom_cte(profile), *extra)} SELECT file, rule, {_badge(profile, 'severity')} AS badge,"
        f" cast({weight()} AS INTEGER) AS weight FROM ({names_sql(profile)}) f"
    )
