"""All queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from ledgerloom.operators import nested, units
from ledgerloom.plans import oracle, queries as plans


def queries() -> dict:
    return {q.__name__: q for q in plans.QUERIES} | {
        "p2_found": units.p2_found,
        "p2_flagged": units.p2_flagged,
        "p3_found": nested.p3_found,
        "p3_items": nested.p3_items,
        "p3_records": nested.p3_records,
        "p3_line_items": nested.p3_line_items,
        "p3_delivery_items": nested.p3_delivery_items,
        "p3_sub_items": nested.p3_sub_items,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
