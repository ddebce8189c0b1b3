import pytest

from ledgerloom.llm.queries import queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs_with_its_columns(spark, tiny, name):
    frame = queries()[name](spark, tiny)
    columns = {
        "p1_found": ["src", "row_id", "line_no", "pii_type"],
        "p4_found": ["name_a", "name_b"],
        "p5_found": ["address_a", "address_b"],
        "p6_found": ["src", "row_id", "pos", "term_id"],
        "p7_ids": ["doc_id", "ids"],
        "p8_found": ["doc_id", "item_id"],
        "p9_found": ["doc_id", "form"],
    }
    if name in columns:
        assert frame.columns == columns[name]
    rows = frame.collect()
    assert rows
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


def test_forms_agree_with_the_labels(spark, tiny):
    found = {r.doc_id: r.form for r in queries()["p9_found"](spark, tiny).collect()}
    labels = spark.read.parquet(f"{tiny}/form_labels.parquet").collect()
    wrong = [r for r in labels if found.get(r.doc_id, "prose") != r.form]
    assert len(wrong) <= 0.1 * len(labels)
