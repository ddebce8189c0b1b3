import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, pipeline, prompts, reconcile, responses, validate
from ledgerloom.sources import catalog, ingest


def long(spark, rows):
    return spark.createDataFrame([(d, t, i, n, None if v is None else json.dumps(v)) for d, t, i, n, v in rows], "doc_id bigint, doc_type string, ord bigint, name string, value_json string")


def score(spark, predicted, truth, kind):
    p = long(spark, [(1, kind, i, k, v) for i, (k, v) in enumerate(predicted.items())])
    t = long(spark, [(1, kind, i, k, v) for i, (k, v) in enumerate(truth.items())])
    compared = evaluate.compare(reconcile.rename_predictions(p, t), t.withColumnRenamed("name", "field"))
    return evaluate.evaluate(compared).first(), evaluate.mismatches(compared).collect()


@pytest.mark.parametrize(
    ("predicted", "truth", "kind", "f1"),
    [
        ({"order_date": "2024-01-01", "due_date": "x"}, {"invoice_date": "2024-01-01", "payment_due_date": "x"}, "invoice", 1.0),
        ({"order_date": "2024-01-01", "due_date": "x"}, {"invoice_date": "2024-01-01", "payment_due_date": "x"}, None, 0.0),
        ({"po_date": "a", "terms": "b"}, {"order_date": "a", "payment_terms": "b"}, "po", 1.0),
        ({"do_number": 1, "courier": "b"}, {"delivery_note_number": 1, "delivered_by": "b"}, "delivery_note", 1.0),
        ({"a": None}, {"a": None}, "po", 1.0),
        ({"a": ""}, {"a": None}, "po", 0.0),
        ({"seller_name": "v"}, {"seller_name": "s", "vendor_name": "v"}, "invoice", 2 / 3),
    ],
)
def test_evaluation(spark, predicted, truth, kind, f1):
    assert score(spark, predicted, truth, kind)[0].f1 == pytest.approx(f1)


def test_wrong_value_is_missed_and_false(spark):
    row, wrong = score(spark, {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 9, "d": None}, "po")
    assert (row.tp, row.fn, row.fp) == (2, 1, 2)
    assert [(m.field, m.predicted, m.expected) for m in wrong] == [("b", "2", "9")]


def fields_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, doc_type string, ord bigint, name string, description string, likely_required boolean")


def test_reconcile_keeps_all_proposals_and_adds_the_rest(spark):
    entries = spark.createDataFrame([("po", 1, "order_date", "order_date", True, "rule"), ("po", 2, "currency", "currency", True, "ISO")], "doc_type string, term_id bigint, norm string, name string, required boolean, description string")
    proposed = fields_of(spark, [(1, "po", 0, "PO Date", "mine", False), (1, "po", 1, "order-date", "too", None), (1, "po", 2, "Novel", "n", True), (2, "other", 0, "x", None, None)])
    rows = {(r.doc_id, r.part, r.ord): (r.name, r.description, r.likely_required) for r in reconcile.reconcile_catalog(proposed, entries).collect()}
    assert rows == {(1, 0, 0): ("order_date", "mine", True), (1, 0, 1): ("order_date", "too", True), (1, 0, 2): ("Novel", "n", True), (1, 1, 2): ("currency", "ISO", True), (2, 0, 0): ("x", None, None)}


def test_split_extracted(spark):
    entries = long(spark, [(1, "invoice", 0, "vendor name", "v"), (1, "invoice", 1, "x", 1), (1, "invoice", 2, "seller_name", "s"), (1, "invoice", 3, "gone", None)])
    wanted = fields_of(spark, [(1, "invoice", 0, "seller_name", None, True)])
    rows = {(r.bucket, r.field): r.value_json for r in reconcile.split_extracted(entries, wanted).collect()}
    assert rows == {("extracted", "seller_name"): '"s"', ("additional", "x"): "1"}


def test_validation(spark):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    fields = spark.createDataFrame([(1, "extracted", "total_amount", "-5"), (1, "additional", "due_date", '"soon"'), (3, "extracted", "a", '"x"')], "doc_id bigint, bucket string, field string, value_json string")
    required = spark.createDataFrame([(1, "total_amount"), (1, "b")], "doc_id bigint, field string")
    issues = validate.validate_issues(documents, fields, required)
    found = {(r.doc_id, r.field, r.severity) for r in issues.collect()}
    assert found == {(2, "*", "error"), (1, "b", "warning"), (1, "total_amount", "warning"), (1, "due_date", "warning")}
    many = spark.createDataFrame([(1, "total_amount", True)] + [(1, f"f{i}", None) for i in range(31)], "doc_id bigint, field string, required boolean")
    summary = {r.doc_id: (r.is_valid, r.completeness) for r in validate.validate_summary(documents, fields, many).collect()}
    assert summary == {1: (True, 0.0312), 2: (False, 0.0), 3: (True, 1.0)}


def test_responses(spark):
    good = '{"score": "0.9", "issues": [], "notes": "n"}'
    rows = [good, f"```json\n{good}\n```", f"Sure: {good} bye", '{"score": 1.2}', '{"score": 0.9', "no", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = [r.n for r in frame.select("i", responses.judge_response(F.col("raw"))["notes"].alias("n")).orderBy("i").collect()]
    assert got == ["n", "n", "n", None, None, None, None]
    two = frame.select(responses.two_attempts(F.col("raw"), F.lit(good), responses.judge_response).alias("r")).select("r.attempt", "r.error").collect()
    assert [r.attempt for r in two] == [1, 1, 1, 2, 2, 2, 2] and all(r.error is None for r in two)


def test_doc_types_and_aliases(spark):
    rows = [("Purchase Order", "po", False), (" PO ", "po", False), ("delivery-note", "delivery-note", True), ("Delivery Note", "delivery_note", False), ("receipt", "receipt", True)]
    frame = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = [tuple(r) for r in frame.select(catalog.canonical_type(F.col("t")).alias("c")).select("c.*").collect()]
    assert got == [r[1:] for r in rows]
    assert len(catalog.synonym_rows()) == 85


def test_few_shot_budget(spark):
    sizes = {"invoice": [676, 381, 392, 782, 285], "po": [597, 663, 447, 650, 138], "delivery_note": [568, 459, 379, 587, 280], "big": [2000, 1]}
    frame = spark.createDataFrame([(t, f"{i}", s) for t, v in sizes.items() for i, s in enumerate(v)], "doc_type string, file string, size bigint")
    kept = {r.doc_type: r["count"] for r in prompts.few_shot_budget(frame).groupBy("doc_type").count().collect()}
    assert kept == {"invoice": 3, "po": 2, "delivery_note": 3, "big": 1}


def test_images_and_groups(spark):
    rows = [(1, 0, "a.PNG", None, 3), (1, 1, "b", "image/JPEG", 4), (2, 0, "c.pdf", "application/pdf", 5)]
    frame = spark.createDataFrame(rows, "group_id bigint, part_no int, filename string, content_type string, bytes bigint")
    got = {r.group_id: (r.group_name, r.total_bytes, r.all_images) for r in ingest.group_meta(frame).collect()}
    assert got == {1: ("2 files (a.PNG, ...)", 7, True), 2: ("c.pdf", 5, False)}
    assert [r.m for r in frame.select(ingest.media_type(F.col("filename"), F.col("content_type")).alias("m")).collect()] == ["image/png", "image/jpeg", "image/jpeg"]


def test_pipeline_stops_at_the_first_failure(spark):
    base = {"doc_type": "po", "is_image": False, "has_text": True, "n_fields": 2, "is_valid": True, "score": 0.9} | {f"{s}_kind": None for s in pipeline.STAGES} | {f"{s}_message": "m" for s in pipeline.STAGES}
    rows = [base, base | {"router_kind": "call"}, base | {"extractor_kind": "call"}, base | {"judge_kind": "other"}, base | {"validator_kind": "other"}, base | {"is_image": True, "n_fields": 0}, base | {"has_text": False}, base | {"score": 0.6}]
    schema = "doc_type string, is_image boolean, has_text boolean, n_fields int, is_valid boolean, score double, " + ", ".join(f"{s}_kind string" for s in pipeline.STAGES) + ", " + ", ".join(f"{s}_message string" for s in pipeline.STAGES)
    got = [(r.failed_stage, r.doc_type, r.needs_review) for r in pipeline.run_stages(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(None, "po", False), ("router", None, True), ("extractor", "po", True), (None, "po", True), ("validator", "po", True), ("extractor", "po", True), ("router", None, True), (None, "po", True)]


def test_strict_schema():
    schema = {"title": "T", "type": "object", "properties": {"v": {"title": "V"}, "n": {"type": "object", "properties": {"x": {"type": "string"}}}}}
    out = prompts.strict_schema(schema)
    assert "title" not in out and out["additionalProperties"] is False and out["required"] == ["v", "n"]
    assert len(out["properties"]["v"]["anyOf"]) == 5 and out["properties"]["n"]["required"] == ["x"]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "po_fields.json").write_text(json.dumps({"fields": [{"name": " a ", "type": "", "required": True}, {"name": " "}, {"name": "b", "likely_required": True}]}))
    (tmp_path / "broken.json").write_text("{")
    rows = [(r.doc_type, r.name, r.type, r.required) for r in catalog.read_catalog_files(spark, f"{tmp_path}/*.json").orderBy("ord").collect()]
    assert rows == [("po", "a", None, True), ("po", "b", None, True)]
