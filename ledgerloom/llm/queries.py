"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import addresses, canonical, leakage, names, pii, quality, tokens


def queries() -> dict:
    return {
        "p1_found": pii.p1_found,
        "p1_redacted": pii.p1_redacted,
        "p4_found": names.p4_found,
        "p4_entities": names.p4_entities,
        "p5_found": addresses.p5_found,
        "p5_places": addresses.p5_places,
        "p6_found": canonical.p6_found,
        "p7_ids": tokens.p7_ids,
        "p8_found": leakage.p8_found,
        "p8_overlap": leakage.p8_overlap,
        "p8_leaked_items": leakage.p8_leaked_items,
        "p9_found": quality.p9_found,
        "p9_stats": quality.p9_stats,
    }


def oracle_sql() -> dict[str, str]:
    return {}
