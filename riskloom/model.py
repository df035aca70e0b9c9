"""Shared vocabulary: severities, the finding row, and the three match profiles.

``line``   one finding per (rule, physical line)
``span``   one finding per regex match over the whole text, with per-file taint
``block``  one finding per regex match over the whole text, no taint
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, most severe first, and their weights.
SEVERITIES = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}

# Third-party directories left out of every scan.
VENDOR_DIRS = (
    "google_config",
    "vendor",
    "fb_config",
    "mailer/vendor",
    "test/PHPExcel",
    "classes/mailer",
)

FINDING_COLUMNS = ("scanner", "file", "line", "rule", "severity", "match")

FINDING_DDL = "scanner string, file string, line int, rule string, severity string, match string"


@dataclass(frozen=True)
class Profile:
    """How one flavour of the analysis reads, filters and matches."""

    name: str
    decode: str  # replace | ignore | strict
    extension_any_case: bool
    vendor_rule: str  # rooted | rooted_hidden | component
    dead_line: int  # line number put on file-name findings
    dead_any_extension: bool
    dead_uses_floor: bool


PROFILES = {
    "line": Profile("line", "replace", True, "rooted", 0, False, False),
    "span": Profile("span", "ignore", True, "rooted_hidden", 1, True, True),
    "block": Profile("block", "strict", False, "component", 0, False, True),
}


def profile_of(profile: str | Profile) -> Profile:
    if isinstance(profile, Profile):
        return profile
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}, expected one of {sorted(PROFILES)}")
    return PROFILES[profile]


def weight_of(severity: str) -> int:
    name = severity.upper()
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}, expected one of {list(SEVERITIES)}")
    return SEVERITIES[name]


def severity_weight(severity: Column) -> Column:
    """Weight as a CASE over literals, so no join is needed; unknown names weigh 0."""
    weight = F.lit(0)
    for name, value in SEVERITIES.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight.cast("int")
