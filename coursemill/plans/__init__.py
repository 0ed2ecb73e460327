"""The named queries: each binds operators to the driver's tables, with SQL for the same rows where SQL can say it."""

from . import ledger, paged, queues, retrieval, review, stores, streams, sync, text
from .registry import QUERIES, SQL

FLAGSHIP = "a20_dashboard"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
