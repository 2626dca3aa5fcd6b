"""Registered queries over the operators, with the SQL that checks them."""

from __future__ import annotations

from weft.plans import analysis, chapters, exports, more, records, relational, searching, sessions, texts  # noqa: F401, I001  they register themselves
from weft.plans import recordings, streams  # noqa: F401, I001  after sessions, whose SQL they share
from weft.plans import growing, listed, recorded, upkeep  # noqa: F401  after streams and texts
from weft.plans.base import QUERIES, SQL

FLAGSHIP = "bm25_top20"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
