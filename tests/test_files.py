"""Catalog visibility, uploads, pages, sinks and jobs on files and rows made here."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pipeline, responses
from ledgerloom.sources import catalog, ingest, sinks

FIELDS = "doc_type string, file string, ord int, name string, type string, required boolean"


def test_templates_without_a_catalog(spark):
    none = spark.createDataFrame([], FIELDS)
    assert catalog.visible_templates(none, True).count() == 0
    assert {r.doc_type for r in catalog.visible_templates(none, False).collect()} == {"invoice", "po"}
    some = spark.createDataFrame([("x", "x_fields.json", 0, "a", None, True)], FIELDS)
    assert [r.name for r in catalog.visible_templates(some, False).collect()] == ["a"]


def test_first_file_of_a_type_wins_and_types_keep_the_files_order(spark):
    rows = [("PO ", "b.json", 0, "late", None, True), ("po", "a.json", 0, "early", None, True), ("po", "a.json", 1, "more", None, True), ("invoice", "c.json", 0, "i", None, True)]
    fields = spark.createDataFrame(rows, FIELDS)
    wanted = spark.createDataFrame([(" Po",), ("none",), (None,)], "doc_type string")
    assert sorted(r.name for r in catalog.fields_of_type(fields, wanted).collect()) == ["early", "more"]
    assert [(r.place, r.doc_type) for r in catalog.doc_types_in_order(fields).orderBy("place").collect()] == [(0, "po"), (1, "PO "), (2, "invoice")]
    assert catalog.doc_types_in_order(fields.limit(0)).count() == 0


def test_few_shot_and_truth_files(spark, tmp_path):
    for name, value in {"po/a.json": {"output": {"x": 1}}, "PO/b.json": {"fields": {"y": 2}}, "po/c.json": {"note": 1}}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(value))
    (tmp_path / "po" / "bad.json").write_text("{")
    rows = {(r.doc_type, r.file.split("/")[-1], r.output) for r in catalog.read_few_shot_files(spark, f"{tmp_path}/*/*.json").collect()}
    assert rows == {("po", "a.json", '{"x":1}'), ("po", "b.json", '{"y":2}')}
    counts = catalog.file_counts(spark.createDataFrame([("k/po/a.json",), ("k/po/b.JSON",), ("k/po/c.txt",), ("k/t/d.json",)], "path string"))
    assert {tuple(r) for r in counts.collect()} == {("po", 2), ("t", 1)}
    stems = spark.createDataFrame([("inv_1", "{}")], "file_stem string, truth string")
    pages = spark.createDataFrame([("in/inv_1.pdf",), ("other.pdf",)], "filename string")
    assert {(r.filename, r.truth) for r in catalog.ground_truth(pages, stems).collect()} == {("in/inv_1.pdf", "{}"), ("other.pdf", None)}


def test_uploads_and_pages(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        ingest.read_uploads(spark, str(tmp_path / "none"))
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text("\f")
    files = ingest.read_uploads(spark, f"{tmp_path}/*.txt").withColumn("text", F.decode("content", "utf-8"))
    pages = ingest.split_pages(files).filter("page_text != ''")
    got = {r.filename: (r.n_pages, r.parse_error is None) for r in ingest.parsed_parts(files, pages, "filename").collect()}
    assert got == {"a.txt": (2, True), "b.txt": (0, False)}


def test_groups_are_routed(spark):
    rows = [("v", 1, True, 0, None), ("v", 2, True, 0, None), ("p", 1, True, 1, None), ("p", 2, False, 2, None), ("e", 1, False, 0, None), ("f", 1, False, 3, None), ("f", 2, False, 0, "second"), ("f", 3, False, 0, "third")]
    parts = spark.createDataFrame(rows, "group_id string, part_no int, is_image boolean, n_pages int, parse_error string")
    got = {r.group_id: (r.route, r.error, r.n_documents) for r in pipeline.route_groups(parts).collect()}
    assert got == {"v": ("vision", None, 2), "p": ("parse", None, 3), "e": ("parse", pipeline.NO_PAGES, 0), "f": ("parse", pipeline.PARSE_FAILED + "second", 0)}


def test_calls_that_fail(spark):
    good = '{"score": 0.5, "issues": [], "notes": "n"}'
    rows = [(1, good, None, 10, None, None, None), (2, good, "down", 10, good, None, 7), (3, "no", None, 10, None, "down", None), (4, "no", None, 10, "no", None, 7)]
    frame = spark.createDataFrame(rows, "i int, raw_1 string, failed_1 string, tokens_1 bigint, raw_2 string, failed_2 string, tokens_2 bigint")
    made = frame.select("i", responses.attempted_call(*[F.col(c) for c in frame.columns[1:]], responses.judge_response).alias("r")).orderBy("i").collect()
    assert [(r.r.answer is not None, r.r.attempt, r.r.error, r.r.tokens) for r in made] == [(True, 1, None, 10), (True, 2, None, 7), (False, 2, "down", 10), (False, 2, "unparsable", 7)]


def test_job_ids(spark):
    rows = ["123e4567-e89b-12d3-a456-426614174000", "{123E4567-E89B-12D3-A456-426614174000}", "123e4567e89b12d3a456426614174000", "job-1", "", None]
    frame = spark.createDataFrame([(r,) for r in rows], "j string")
    assert [r.v for r in frame.select(pipeline.valid_job_id(F.col("j")).alias("v")).collect()] == [True, True, True, False, False, False]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("g", 2, "b"), ("g", 1, None)], "job string, page_no int, text string")
    made = sinks.response_json(pages, "job", ["page_no"])
    assert json.loads(made.first().response) == {"request": "g", "documents": [{"page_no": 1, "text": None}, {"page_no": 2, "text": "b"}]}
    sinks.write_responses(made, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="exist"):
        sinks.write_responses(made, str(tmp_path / "out"))
    fields = spark.createDataFrame([(1, 'a"\\]', "[1, 2]"), (1, "b", '"x"'), (1, "c", None)], "doc_id int, field string, value_json string")
    for pretty in (True, False):
        assert json.loads(sinks.export_fields(fields, pretty).first().exported) == {'a"\\]': [1, 2], "b": "x", "c": None}
