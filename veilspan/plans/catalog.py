"""All registered queries and their SQL."""

from __future__ import annotations

from veilspan.plans import finding, scoring, sourcing, spanning
from veilspan.plans.base import QUERIES, SQL, Query

FLAGSHIP = "pii_summary"
MODULES = [finding, scoring, sourcing, spanning]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
