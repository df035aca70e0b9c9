"""Rule sets as data.  A rule compiles to built-in expressions with literal
patterns, so each pattern is compiled once per task and never leaves the JVM.

Patterns stay inside the part of the syntax that Java and RE2 share, apart from
one back-reference noted below.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.model import Profile, profile_of, weight_of

# Case-insensitive, Unicode character classes.
FLAGS = "(?iU)"


@dataclass(frozen=True)
class After:
    """``then`` anywhere after ``first``, with no ``apart`` character between them.

    One pattern ``first.*then`` would look through the rest of the line again from every ``first``.  Whatever follows
    a later ``first`` also follows the earliest one, so looking once behind that is enough: a line of any length takes
    linear time.  For predicates over single lines only.
    """

    first: str
    then: str
    apart: str = ""

    def holds(self, text: Column, flags: str) -> Column:
        def follows(part: Column) -> Column:
            rest = F.regexp_extract(part, f"{flags}(?s){self.first}(.*)", 1)
            return F.rlike(rest, F.lit(flags + self.then))

        found = F.exists(F.split(text, re.escape(self.apart), -1), follows) if self.apart else follows(text)
        return F.rlike(text, F.lit(flags + self.then)) & found


@dataclass(frozen=True)
class RuleSpec:
    """One detection rule.

    ``patterns``  any of them hits; over whole texts they act as one pattern with alternatives, so that matches of one
                  rule never overlap: the leftmost wins, then the pattern named first
    ``veto``      lower-case tokens that cancel a hit on the same line, or, over whole texts, on any line that the
                  match touches
    ``keywords``  lower-case words of which one must occur in any hit; a byte
                  search for them spares most texts the patterns
    ``flags``     inline flags put in front of every pattern
    """

    name: str
    severity: str
    patterns: tuple[str | After, ...]
    veto: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    scanner: str = "security"
    flags: str = FLAGS

    def __post_init__(self) -> None:
        weight_of(self.severity)
        if not self.patterns:
            raise ValueError(f"rule {self.name!r} has no pattern")

    def hits(self, text: Column) -> Column:
        """Predicate over one line (or any text)."""
        found = reduce(
            lambda a, b: a | b,
            [
                p.holds(text, self.flags) if isinstance(p, After) else F.rlike(text, F.lit(self.flags + p))
                for p in self.patterns
            ],
        )
        return found & ~has_token(text, self.veto) if self.veto else found

    def possible(self, low: Column, exotic: Column) -> Column:
        """Cheap test that holds for every hit, on the lower-cased text."""
        if not self.keywords:
            return F.lit(True)
        return reduce(lambda a, b: a | b, [exotic, *(F.contains(low, F.lit(w)) for w in self.keywords)])

    @property
    def text_pattern(self) -> str:
        """All patterns as one, for whole texts."""
        if any(isinstance(p, After) for p in self.patterns):
            raise ValueError(f"rule {self.name!r} is for single lines")
        if len(self.patterns) == 1:
            return self.flags + self.patterns[0]
        if any(_BACK_REFERENCE.search(p) for p in self.patterns):
            raise ValueError(f"rule {self.name!r}: a pattern that refers back must be the only one")
        return self.flags + "|".join(f"(?:{p})" for p in self.patterns)


# A numbered back-reference, which other patterns' groups would shift.
_BACK_REFERENCE = re.compile(r"(?<!\\)(?:\\\\)*\\[1-9]")


def has_token(text: Column, tokens: Iterable[str]) -> Column:
    """True when the text contains one of the ASCII tokens in any letter case."""
    return F.rlike(text, F.lit(f"(?i){'|'.join(map(re.escape, tokens))}"))


# Characters outside ASCII that equal an ASCII letter when case is ignored.
_EXOTIC_LETTERS = "\u0130\u0131\u017f\u212a"


def is_exotic(text: Column) -> Column:
    """A case-insensitive match may not show in the lower-cased text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _EXOTIC_LETTERS])


def at_least(rules: Iterable[RuleSpec], floor: str | None) -> tuple[RuleSpec, ...]:
    """Drop rules below the severity floor before anything is planned.

    Every rule has one severity, so this equals filtering the findings.
    """
    if floor is None:
        return tuple(rules)
    minimum = weight_of(floor)
    return tuple(r for r in rules if weight_of(r.severity) >= minimum)


# Tokens that mark a line as sanitized (line profile).
SANITIZERS = (
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

# Tokens that keep an assignment from tainting (span profile).
TAINT_SANITIZERS = (
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

# Building blocks of the patterns below.
_REQUEST = r"\$_(?:GET|POST|REQUEST)"
_REQUEST_COOKIE = r"\$_(?:GET|POST|REQUEST|COOKIE)"
_INCLUDE = r"(?:include|require)(?:_once)?"
_SHELL = r"(?:shell_exec|exec|system|passthru)\s*\("
_CALL = r"(?:query|execute)\s*\("
_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"

# Vulnerability rules of the line profile.
LINE_SECURITY = (
    RuleSpec(
        "sql_injection",
        "CRITICAL",
        (
            After(rf"(?:->|\b){_CALL}", rf"{_REQUEST}\s*\["),
            After(rf"(?:->|\b){_CALL}", rf"\.\s*{_REQUEST}", apart=")"),
        ),
        veto=SANITIZERS,
        keywords=("query", "execute"),
    ),
    RuleSpec("eval_usage", "HIGH", (r"\beval\s*\(",), keywords=("eval",)),
    RuleSpec(
        "xss_direct_echo",
        "HIGH",
        (After(r"\becho\b", rf"{_REQUEST_COOKIE}\s*\["),),
        veto=SANITIZERS,
        keywords=("echo",),
    ),
    RuleSpec(
        "dynamic_include",
        "HIGH",
        (
            rf"\b{_INCLUDE}\s*[(\s]['\"]*\s*\$\w",
            rf"\b{_INCLUDE}\s*\(?\s*(?:['\"]\w+['\"]\s*\.\s*)?\$\w",
        ),
        keywords=("include", "require"),
    ),
    RuleSpec(
        "shell_exec", "CRITICAL", (rf"\b{_SHELL}",), keywords=("exec", "system", "passthru")
    ),
    RuleSpec(
        "open_redirect",
        "MEDIUM",
        (r"header\s*\(\s*['\"]Location:\s*['\"]?\s*\.\s*\$_",),
        keywords=("header",),
    ),
)

# Vulnerability rules of the span profile.  SQL injection is
# taint-based and lives in operators.taint.  The redirect rule needs a
# back-reference: the quote that opens the literal also closes it.
SPAN_SECURITY = (
    RuleSpec("eval_usage", "HIGH", (r"\beval\s*\(",), keywords=("eval",)),
    RuleSpec(
        "shell_exec", "CRITICAL", (rf"\b{_SHELL}",), keywords=("exec", "system", "passthru")
    ),
    RuleSpec(
        "dynamic_include",
        "HIGH",
        (rf"\b{_INCLUDE}\s*(?:\(\s*)?\${_IDENTIFIER}",),
        keywords=("include", "require"),
    ),
    RuleSpec("xss_direct_echo", "HIGH", (rf"\becho\s+{_REQUEST_COOKIE}\b",), keywords=("echo",)),
    RuleSpec(
        "open_redirect",
        "MEDIUM",
        (r"\bheader\s*\(\s*(['\"])Location:.*?\1\s*\.\s*\$_",),
        keywords=("header",),
        flags="(?isU)",
    ),
)
SPAN_SQL_INJECTION = RuleSpec(
    "sql_injection", "CRITICAL", (rf"->\s*{_CALL}",), keywords=("query", "execute")
)
SUPERGLOBAL = rf"{FLAGS}{_REQUEST_COOKIE}\b"

# Vulnerability rules of the block profile, no word boundaries.
# SQL injection spans from the first call to the last request value of a file
# and is evaluated in two anchored steps, see operators.scan.
BLOCK_SECURITY = (
    RuleSpec("eval_usage", "HIGH", (r"eval\s*\(",), keywords=("eval",)),
    RuleSpec("xss_direct_echo", "HIGH", (rf"echo\s+{_REQUEST_COOKIE}\s*\[",), keywords=("echo",)),
    RuleSpec("dynamic_include", "HIGH", (rf"{_INCLUDE}\s*\(?\$",), keywords=("include", "require")),
    RuleSpec("shell_exec", "CRITICAL", (_SHELL,), keywords=("exec", "system", "passthru")),
    RuleSpec(
        "open_redirect",
        "MEDIUM",
        (r"header\s*\(\s*['\"]Location:\s*['\"]\s*\.\s*\$_",),
        keywords=("header",),
    ),
)
BLOCK_SQL_INJECTION = RuleSpec(
    "sql_injection",
    "CRITICAL",
    (rf"{_CALL}.*{_REQUEST}\[",),
    keywords=("query", "execute"),
    flags="(?isU)",
)
BLOCK_CALL_TO_END = rf"(?isU){_CALL}.*"
BLOCK_UP_TO_LAST_REQUEST = rf"(?isU)\A.*{_REQUEST}\["

_QUOTED = r"(?:'[^']+'|\"[^\"]+\")"
_SECRET_NAME = r"\$\w*(?:key|secret|token|password)\w*"
_BASE64_OVER_40 = (
    r"(?:[A-Za-z0-9+/]{41,}={0,2}|[A-Za-z0-9+/]{40}={1,2}|[A-Za-z0-9+/]{39}==)"
)

# Credential rules, the same for all profiles; only the match unit differs.
CREDENTIALS = (
    RuleSpec(
        "hardcoded_db_password",
        "CRITICAL",
        (rf"\bnew\s+(?:mysqli|MysqliDb)\s*\([^,;]*,[^,;]*,\s*{_QUOTED}",),
        keywords=("mysqli",),
        scanner="credential",
    ),
    RuleSpec(
        "define_secret",
        "CRITICAL",
        (rf"\bdefine\s*\(\s*['\"][^'\"]*(?:KEY|SECRET|PASSWORD|TOKEN)[^'\"]*['\"]\s*,\s*{_QUOTED}",),
        keywords=("define",),
        scanner="credential",
    ),
    RuleSpec(
        "hardcoded_assignment",
        "HIGH",
        (rf"{_SECRET_NAME}\s*=\s*{_QUOTED}",),
        keywords=("key", "secret", "token", "password"),
        scanner="credential",
    ),
    RuleSpec(
        "base64_encoded_key",
        "HIGH",
        (rf"{_SECRET_NAME}\s*=\s*['\"]{_BASE64_OVER_40}['\"]",),
        keywords=("key", "secret", "token", "password"),
        scanner="credential",
    ),
)

# The assignment rule without the sigil, for prose and configuration files.
PLAIN_ASSIGNMENT = RuleSpec(
    "hardcoded_assignment",
    "HIGH",
    # Only from the start of a word, else every letter of a long word is tried.
    (rf"(?<!\w)\w*(?:key|secret|token|password)\w*+\s*+=\s*{_QUOTED}",),
    keywords=("key", "secret", "token", "password"),
    scanner="credential",
)

# Leak rules: secrets of well-known providers, case-sensitive.
LEAKS = (
    RuleSpec(
        "live_payment_key",
        "CRITICAL",
        (r"\b[rs]k_live_[0-9A-Za-z]{16,}",),
        keywords=("k_live_",),
        scanner="leak",
        flags="",
    ),
    RuleSpec(
        "cloud_access_key",
        "CRITICAL",
        (r"\bA[KS]IA[0-9A-Z]{16}\b",),
        keywords=("akia", "asia"),
        scanner="leak",
        flags="",
    ),
    RuleSpec(
        "code_host_token",
        "CRITICAL",
        (r"\bgh[opsur]_[0-9A-Za-z]{36,}",),
        keywords=("gho_", "ghp_", "ghs_", "ghu_", "ghr_"),
        scanner="leak",
        flags="",
    ),
    RuleSpec(
        "private_key",
        "CRITICAL",
        (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",),
        keywords=("private key-----",),
        scanner="leak",
        flags="",
    ),
    RuleSpec(
        "hardcoded_password",
        "HIGH",
        (r"(?:password|passwd|token)['\"]?\s*(?:=>|=|:)\s*(?:'[^'\s]{6,}'|\"[^\"\s]{6,}\")",),
        keywords=("password", "passwd", "token"),
        scanner="leak",
        flags="(?i)",
    ),
)
LEAK_EXTENSIONS = (".py", ".php", ".env")
ALLOW_MARKERS = ("FAKE", "PLACEHOLDER", "EXAMPLE")


def security_rules(profile: str | Profile) -> tuple[RuleSpec, ...]:
    """Rules of the one-pass scan; the two SQL injection specials included by name."""
    name = profile_of(profile).name
    if name == "line":
        return LINE_SECURITY
    if name == "span":
        return (SPAN_SQL_INJECTION, *SPAN_SECURITY)
    return (BLOCK_SQL_INJECTION, *BLOCK_SECURITY)
