"""The registered queries over the library's operators, each on whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from . import etl, fields, geometry, scoring, splitting  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "source_match"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
