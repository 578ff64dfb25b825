"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from cairn import queries_plans, queries_space, queries_time


def queries() -> dict:
    return {**queries_space.QUERIES, **queries_time.QUERIES, **queries_plans.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_space.SQL, **queries_time.SQL, **queries_plans.SQL}
