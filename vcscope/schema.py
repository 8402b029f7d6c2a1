"""Explicit schemas of the five history tables."""

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


COMMITS = _struct(
    ("commit_hash", S, False),
    ("repo_name", S, False),
    ("author", S, True),
    ("date", TS, True),
    ("timezone", S, True),
    ("is_merge", I, False),
    ("total_additions", L, False),
    ("total_deletions", L, False),
    ("total_additions_test", L, False),
    ("total_deletions_test", L, False),
    ("total_additions_dot", L, False),
    ("total_deletions_dot", L, False),
    ("total_additions_build", L, False),
    ("total_deletions_build", L, False),
    ("message", S, True),
)

FILE_CHANGES = _struct(
    ("id", L, False),
    ("commit_hash", S, False),
    ("repo_name", S, False),
    ("author", S, True),
    ("change_type", S, True),
    ("file_path", S, True),
    ("additions", L, False),
    ("deletions", L, False),
    ("is_test_file", I, False),
    ("is_build_file", I, False),
    ("is_dot_file", I, False),
    ("is_documentation_file", I, False),
    ("similarity", I, True),
    ("new_path", S, True),
)

COMMIT_PARENTS = _struct(
    ("commit_hash", S, False),
    ("repo_name", S, False),
    ("parent_hash", S, False),
)

BRANCHES = _struct(
    ("branch_name", S, False),
    ("repo_name", S, False),
    ("is_active", I, False),
    ("creation_date", TS, True),
    ("merge_date", TS, True),
)

TAGS = _struct(
    ("tag_name", S, False),
    ("repo_name", S, False),
    ("tag_commit", S, True),
    ("tag_message", S, True),
)

ALL = {
    "commits": COMMITS,
    "file_changes": FILE_CHANGES,
    "commit_parents": COMMIT_PARENTS,
    "branches": BRANCHES,
    "tags": TAGS,
}

# Primary keys (used by de-duplication and the data-quality check).
KEYS = {
    "commits": ["repo_name", "commit_hash"],
    "file_changes": ["id"],
    "commit_parents": ["repo_name", "commit_hash", "parent_hash"],
    "branches": ["repo_name", "branch_name"],
    "tags": ["repo_name", "tag_name"],
}
