"""riskloom: source-code risk analytics expressed as Spark DataFrame plans.

A source tree is a table ``files(path, content)``.  Every operator takes
DataFrames and returns DataFrames; Catalyst owns the physical plan.
"""

from riskloom.model import PROFILES, SEVERITIES, Profile
from riskloom.plans.analyze import Analysis, analyze, run_job

__all__ = ["PROFILES", "SEVERITIES", "Profile", "Analysis", "analyze", "run_job"]
