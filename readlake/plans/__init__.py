"""Registered queries over the driver's tables, and their SQL."""

from readlake.plans import alignment, books, lookup, reading, statistics

FAMILIES = [statistics, books, lookup, alignment, reading]


def registered() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for family in FAMILIES:
        queries |= family.QUERIES
        sql |= family.ORACLES
    return queries, sql
