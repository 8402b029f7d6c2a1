"""Operators over the history tables. Importing this package registers every
named query in :mod:`vcscope.plans.catalog`."""

from . import (  # noqa: F401
    authors, branches, bugs, changes, collab, commits, debt, ingestion, onboarding, other, productivity, releases,
    reports, search,
)
from . import scoped  # noqa: F401, E402  (last: it registers variants of the others)
