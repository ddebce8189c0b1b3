"""Given names that no table holds, and tables of one's own."""

import pytest

from ledgerloom.llm import names


def entities(spark, rows, nicknames=None):
    frame = spark.createDataFrame([(r,) for r in rows], "text string")
    out = {}
    for r in names.same_names(frame, nicknames).collect():
        out.setdefault(r.entity, set()).add(r.text)
    return {frozenset(v) for v in out.values()}


def test_other_given_names(spark):
    groups = [{"Priya Raghunathan", "P. Raghunathan", "Raghunathan, P."}, {"Charles Dickens", "Charlie Dickens"}, {"Jon Smith", "Jonathan Smith"}, {"Mateusz Nowak"}, {"Marek Nowak"}, {"M. Nowak"}, {"Al Kowalczyk"}, {"Alojzy Kowalczyk"}]
    assert entities(spark, [n for g in groups for n in g]) == {frozenset(g) for g in groups}


def test_a_table_of_nicknames(spark):
    table = spark.createDataFrame([("Aleksandra", "Ola"), ("Malgorzata", "Gosia"), (None, "x"), ("Jan", None)], "name string, nickname string")
    rows = ["Aleksandra Nowicka", "Ola Nowicka", "Gosia Nowicka", "Malgorzata Nowicka", "Robert Zielinski", "Bob Zielinski"]
    assert entities(spark, rows, table) == {frozenset(rows[:2]), frozenset(rows[2:4]), frozenset(rows[4:5]), frozenset(rows[5:])}


@pytest.mark.parametrize(("a", "b", "want"), [("p.", "priya", "a"), ("priya", "p.", "b"), ("p.", "p.", "equal"), ("jon", "jonathan", "a"), ("jo", "jonathan", None), ("alexander|alexandra", "alexandra", "equal"), ("mark", "marek", None)])
def test_given_like(a, b, want):
    assert names.given_like(a, b) == want
