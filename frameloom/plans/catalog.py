"""Every query of the activity engine by name, with the SQL it is held against."""

from __future__ import annotations

from . import assemble, basic, desk, detect, more, parse, sequence, tell  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "session_summary"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
