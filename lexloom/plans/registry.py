"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import cases, code, feeds, gallery, streams, tabular, textual, values  # noqa: F401  (they register their queries)
from .register import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "rule_issues"
