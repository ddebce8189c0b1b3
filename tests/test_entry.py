"""The driver's contract on the smallest tables: every query runs, and equals its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerloom import registry


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tiny, name):
    frame = registry.queries()[name](spark, tiny)
    rows = sorted(([canon(r[c]) for c in sorted(frame.columns)] for r in frame.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for path in Path(tiny).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(([canon(v) for _, v in sorted(zip(names, r, strict=True))] for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(frame.columns)
    assert rows == want


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["doc_id", "tp", "fn", "fp", "precision", "recall", "f1"]
