"""DuckDB SQL equivalents of the catalogue (the correctness oracle).

Each body is written against the five history tables; ``oracle_sql()`` puts
the adapter views in front, so the text runs on the driver's tables. Bodies
may start with their own ``WITH``; the CTE lists are merged.
"""

from __future__ import annotations

import re

from ..operators.reports import RANGE_FROM, RANGE_TO
from ..operators.scoped import BY_REPO, SCOPED

BODIES: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    if name in BODIES:
        raise ValueError(f"duplicate oracle {name}")
    BODIES[name] = body.strip().rstrip(";")


def combine(views: str, body: str) -> str:
    b = body.lstrip()
    if b[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views[4:].lstrip()},\n{b[14:].lstrip()}"
    if b[:4].upper() == "WITH":
        return f"{views},\n{b[4:].lstrip()}"
    return f"{views}\n{b}"


def oracle_sql() -> dict[str, str]:
    from ..sources.fixtures import duckdb_views
    from . import oracle_bodies  # noqa: F401  (fills BODIES)
    views = duckdb_views()
    out = {name: combine(views, body) for name, body in BODIES.items()}
    for name in SCOPED:
        out[f"{name}_between"] = combine(scoped_views(views, RANGE_SQL), BODIES[name])
    out |= {f"{name}_by_repo": by_repo(views, BODIES[name]) for name in BY_REPO}
    return out


# The adapter's repositories are the market segments of the customers.
REPOS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def by_repo(views: str, body: str) -> str:
    """The body over each repository's own tables, with its name. Rows that name a
    repository themselves take the name twice, and one of the two is left out."""
    each = [f"SELECT *, '{r}' AS repo_name FROM ({combine(scoped_views(views, f"repo_name = '{r}'"), body)}) q"
            for r in REPOS]
    if re.search(r"\brepo_name\b", body.split("FROM")[0] if not body.lstrip().upper().startswith("WITH") else ""):
        each = [f"SELECT * FROM ({combine(scoped_views(views, f"repo_name = '{r}'"), body)}) q" for r in REPOS]
    return "\nUNION ALL\n".join(each)


def scoped_views(views: str, rule: str) -> str:
    """The views over the commits that a rule keeps, and what belongs to them."""
    for name in ("commits", "file_changes", "commit_parents", "branches", "tags"):
        views = re.sub(rf"(?m)^{name} AS \(", f"all_{name} AS (", views)
        views = re.sub(rf"(?<![\w.]){name}(?= (f|fc|c|GROUP|ON|JOIN|WHERE)\b)", f"all_{name}", views)
    own = "(repo_name, {h}) IN (SELECT (repo_name, commit_hash) FROM commits)"
    branches = "" if "date" in rule else f" WHERE {rule}"
    return f"""{views},
commits AS (SELECT * FROM all_commits WHERE {rule}),
file_changes AS (SELECT * FROM all_file_changes WHERE {own.format(h="commit_hash")}),
commit_parents AS (SELECT * FROM all_commit_parents WHERE {own.format(h="commit_hash")}),
branches AS (SELECT * FROM all_branches{branches}),
tags AS (SELECT * FROM all_tags WHERE {own.format(h="tag_commit")})"""


RANGE_SQL = (f"date BETWEEN TIMESTAMP '{RANGE_FROM} 00:00:00' AND TIMESTAMP '{RANGE_TO} 23:59:59'")
