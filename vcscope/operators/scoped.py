"""Catalogue queries over a date range, and of each repository for itself.

Any operator runs on ``Tables.between(from_, to)``, ``Tables.of_repos(…)`` and
``Tables.by_repo()``; registered here is one of each domain."""

from __future__ import annotations

from ..plans.catalog import REGISTRY, register
from .reports import RANGE_FROM, RANGE_TO

SCOPED = ("commits_per_author", "code_ownership_files", "file_hotspots_by_churn", "bug_fix_files",
          "commits_per_author_over_time", "merge_conflicts", "change_coupling", "low_ownership_hotspots",
          "newcomer_first_commits", "release_commits", "language_usage")
BY_REPO = ("commit_size_distribution", "code_ownership_files", "file_hotspots_by_churn", "defect_risk",
           "productivity_comparison", "long_lived_branches", "change_coupling", "bus_factor_modules",
           "refactoring_impact", "newcomer_hard_areas", "release_commits", "expertise")

for _name in SCOPED:
    register(f"{_name}_between")(lambda t, _f=REGISTRY[_name]: _f(t.between(RANGE_FROM, RANGE_TO)))
for _name in BY_REPO:
    register(f"{_name}_by_repo")(lambda t, _f=REGISTRY[_name]: _f(t.by_repo()))
