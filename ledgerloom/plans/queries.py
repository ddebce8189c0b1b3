"""The reference's operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import match, normalize
from ledgerloom.operators import evaluate, pipeline, prompts, reconcile, responses, validate
from ledgerloom.plans import derived
from ledgerloom.sources import catalog, ingest
from ledgerloom.tables import table


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Each extracted field once: doc_id, doc_type, ord, name, value_json and the rest."""
    rows = table(spark, folder, "extracted_fields", "entry_id", "result_id", "doc_type", "ord", "name", "value", "source_span", "likely_required", "confidence").distinct()
    return rows.withColumnsRenamed({"result_id": "doc_id", "value": "value_json"}).withColumn("ord", F.col("ord").cast("bigint"))


def latest_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The last router response of each result."""
    rows = table(spark, folder, "routing_responses", "response_id", "result_id", "doc_type", "suggested_fields").dropDuplicates(["response_id"])
    return reconcile.keep_last(rows, ["result_id"], ["response_id"]).withColumn("type", catalog.canonical_type(F.col("doc_type"))["doc_type"])


def suggested(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_responses(spark, folder)
    return rows.select(F.col("result_id").alias("doc_id"), F.col("type").alias("doc_type"), F.posexplode("suggested_fields").alias("ord", "f")).select("doc_id", "doc_type", F.col("ord").cast("bigint").alias("ord"), "f.name", "f.description", "f.likely_required").filter("name is not null")


def results(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each page result once."""
    return table(spark, folder, "extraction_results", "result_id", *columns).dropDuplicates(["result_id"])


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "extracted_fields", "name").filter("name is not null").distinct()
    return names.select("name", normalize.normalize_name(F.col("name")).alias("norm"))


def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "extracted_fields", "doc_type", "name").filter("name is not null").distinct()
    norm = normalize.normalize_name(F.col("name"))
    return names.select("doc_type", "name", catalog.resolve_alias(F.col("doc_type"), norm).alias("canonical"))


def doc_type_canonical(spark: SparkSession, folder: str) -> DataFrame:
    types = table(spark, folder, "routing_responses", F.col("doc_type").alias("raw")).filter("raw is not null").distinct()
    return types.select("raw", catalog.canonical_type(F.col("raw")).alias("c")).select("raw", "c.doc_type", "c.out_of_catalog")


def scalar_values(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).filter(~normalize.is_container(F.col("value_json"))).withColumn("text", normalize.scalar_text(F.col("value_json")))


def parse_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return scalar_values(spark, folder).select("entry_id", normalize.parse_number(F.col("text")).alias("number"))


def parse_dates_compare(spark: SparkSession, folder: str) -> DataFrame:
    return scalar_values(spark, folder).select("entry_id", normalize.parse_date(F.col("text")).cast("string").alias("day"))


def parse_dates_validate(spark: SparkSession, folder: str) -> DataFrame:
    return scalar_values(spark, folder).select("entry_id", normalize.parse_date(F.col("text"), normalize.VALIDATE_FORMATS).cast("string").alias("day"))


def string_equal(spark: SparkSession, folder: str) -> DataFrame:
    return scalar_values(spark, folder).filter("text is not null and source_span is not null").select("entry_id", normalize.same_text(F.col("text"), F.col("source_span")).alias("same"))


def values_match_scalar(spark: SparkSession, folder: str) -> DataFrame:
    both = evaluate.compare(renamed(spark, folder), truth(spark, folder))
    return both.select("doc_id", "field", "predicted", "expected", "matched")


def values_match_container(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' line items as a list, against the same list as JSON text with other spellings of its numbers."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    spelled = F.struct(F.lower("l_returnflag").alias("flag"), F.concat(F.lit(" "), F.col("l_quantity").cast("string")).alias("qty"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")).alias("no"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("a"), spelled.alias("b")))).alias("r"))
    a = F.to_json(F.transform("r", lambda x: x["a"]))
    b = F.to_json(F.array(F.to_json(F.transform("r", lambda x: x["b"]))))
    b = F.regexp_replace(b, r"^\[|\]$", "")
    return grouped.select("doc_id", match.values_match(a, b).alias("matched"))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return derived.truth(spark, folder).withColumnRenamed("name", "field")


def renamed(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.rename_predictions(derived.predictions(spark, folder), derived.truth(spark, folder))


def rename_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return renamed(spark, folder).select("doc_id", "ord", "field", "value_json")


def evaluate_f1_by_doc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.evaluate(evaluate.compare(renamed(spark, folder), truth(spark, folder)))


def evaluate_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.mismatches(evaluate.compare(renamed(spark, folder), truth(spark, folder)))


def corpus_rollup(spark: SparkSession, folder: str) -> DataFrame:
    compared = evaluate.compare(renamed(spark, folder), truth(spark, folder)).withColumn("doc_type", F.lit("po"))
    return evaluate.corpus_rollup(compared)


def auto_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """Pages find their truth by the stem of the file name; files without truth have no evaluation."""
    pages = table(spark, folder, "orders", "o_orderkey").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("scan."), F.col("o_orderkey"))).otherwise(F.concat(F.lit("in/po_"), F.col("o_orderkey"), F.lit(".v1.pdf"))).alias("filename"))
    stems = pages.withColumn("stem", normalize.file_stem(F.col("filename"))).select("filename", "stem")
    scores = evaluate_f1_by_doc(spark, folder).select(F.concat(F.lit("po_"), F.col("doc_id"), F.lit(".v1")).alias("stem"), "f1")
    return stems.join(scores, "stem", "left").select("filename", "stem", "f1")


def reconcile_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.reconcile_catalog(suggested(spark, folder), catalog.field_catalog(spark, folder))


def split(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.split_extracted(entries(spark, folder).filter("name is not null"), suggested(spark, folder))


def split_extracted(spark: SparkSession, folder: str) -> DataFrame:
    return split(spark, folder).select("doc_id", "bucket", "field", "ord", "value_json")


def prediction_projection(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.prediction(split(spark, folder)).select("doc_id", "field", "bucket", "value_json")


def checked(spark: SparkSession, folder: str) -> DataFrame:
    documents = results(spark, folder).select(F.col("result_id").alias("doc_id"))
    wanted = suggested(spark, folder).select("doc_id", F.col("name").alias("field"), F.col("likely_required").alias("required"))
    return validate.validated(documents, split(spark, folder), wanted)


def validate_issues(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).select("doc_id", F.inline("issues"))


def validate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).filter("listed").select("doc_id", "is_valid", "completeness", F.size("issues").cast("bigint").alias("n_issues"))


def needs_review(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder, "doc_type", "validation", "judge", "failed_stage", "error")
    out = catalog.canonical_type(F.col("doc_type"))["out_of_catalog"]
    failed = F.col("failed_stage").isNotNull() | F.col("error").isNotNull()
    return rows.select("result_id", validate.needs_review(F.col("validation.is_valid"), F.col("judge.score"), True, out, failed).alias("review"))


def error_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with an issue of severity error, and the judge's score with the number of its issues."""
    rows = results(spark, folder, "validation", "judge")
    has = F.coalesce(F.exists("validation.issues", lambda i: i["severity"] == "error"), F.lit(False))
    return rows.select("result_id", has.alias("has_error"), F.col("judge.score").alias("score"), F.coalesce(F.size("judge.issues"), F.lit(0)).cast("bigint").alias("n_judge_issues"))


def few_shot_budget(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, kind in (("invoices", "invoice"), ("purchase_orders", "po"), ("delivery_notes", "delivery_note")):
        parts.append(table(spark, folder, name, "file_stem", "source_system", "output").dropDuplicates(["file_stem"]).select(F.concat(F.lit(kind + "/"), F.coalesce("source_system", F.lit("-"))).alias("doc_type"), F.col("file_stem").alias("file"), prompts.example_size(F.col("output")).alias("size")))
    return prompts.few_shot_budget(parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("size is not null")).select("doc_type", "file", "size", F.col("turn").cast("bigint").alias("turn"), "used")


def raw_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Judge answers as a model may send them: plain, fenced, within prose, or broken; the second attempt is plain."""
    rows = results(spark, folder, "judge").filter("judge is not null and judge.score is not null")
    body = F.concat(F.lit('{"score": '), F.format_string("%.3f", "judge.score"), F.lit(', "issues": [], "notes": "n'), F.col("result_id"), F.lit('"}'))
    kind = F.col("result_id") % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(kind == 3, F.substring(body, 1, 14)).otherwise(F.lit("sorry"))
    second = F.when(F.col("result_id") % 10 == 9, F.lit(None).cast("string")).otherwise(body)
    return rows.select("result_id", raw.alias("raw_1"), second.alias("raw_2"))


def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    parsed = responses.judge_response(F.col("raw_1"))
    return raw_answers(spark, folder).select("result_id", parsed["score"].try_cast("double").alias("score"), parsed["notes"].alias("notes"))


def two_attempts(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_answers(spark, folder).select("result_id", responses.two_attempts(F.col("raw_1"), F.col("raw_2"), responses.judge_response).alias("r"))
    return rows.select("result_id", F.col("r.answer.notes").alias("notes"), F.col("r.attempt").cast("bigint").alias("attempt"), F.col("r.error").alias("error"))


def pipeline_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder, "doc_type", "full_text", "validation", "judge", "failed_stage")
    return rows.select("result_id", pipeline.stage_number(F.col("failed_stage"), F.col("doc_type").isNotNull(), F.col("full_text").isNotNull(), F.col("validation").isNotNull(), F.col("judge").isNotNull()).cast("bigint").alias("stage"))


def two_attempts_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """C5, A9 with failed transports: the first call of every seventh page fails, the second of every third."""
    key = F.col("result_id")
    rows = raw_answers(spark, folder)
    made = responses.attempted_call(F.col("raw_1"), F.when(key % 7 == 0, "timeout"), F.length("raw_1").cast("bigint"), F.col("raw_2"), F.when(key % 3 == 0, "refused"), F.length("raw_2").cast("bigint"), responses.judge_response)
    return rows.select("result_id", made.alias("r")).select("result_id", F.col("r.answer.notes").alias("notes"), F.col("r.attempt").cast("bigint").alias("attempt"), F.col("r.error").alias("error"), F.col("r.tokens").alias("tokens"))


def pipeline_run(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through router, extractor, validator and judge; each stage's result is that of its operator, its failure what the page's row records."""
    rows = results(spark, folder, "filename", "full_text", "judge", "failed_stage", "error")
    routed = latest_responses(spark, folder).select("result_id", F.col("type").alias("doc_type"), catalog.canonical_type(F.col("doc_type"))["out_of_catalog"].alias("out_of_catalog"))
    checks = checked(spark, folder).select(F.col("doc_id").alias("result_id"), "n_fields", "is_valid")
    stage, error = F.col("failed_stage"), F.col("error")
    kinds = {f"{s}_kind": F.when(stage == s, "call") for s in pipeline.STAGES}
    kinds["router_kind"] = F.when(stage.isNull() & error.isNotNull(), "other").otherwise(kinds["router_kind"])
    pages = (
        rows.join(routed, "result_id", "left")
        .join(checks, "result_id", "left")
        .withColumns({"is_image": ingest.is_image(F.col("filename"), F.lit(None).cast("string")), "has_text": F.coalesce(normalize.strip(F.col("full_text")), F.lit("")) != "", "score": F.col("judge.score")})
        .withColumns({f"{s}_message": F.coalesce(error, F.lit("?")) for s in pipeline.STAGES} | kinds)
        .drop("error", "failed_stage")
    )
    return pipeline.run_stages(pages).select("result_id", "doc_type", "n_fields", "is_valid", "score", "failed_stage", "error", "needs_review")


def group_routing(spark: SparkSession, folder: str) -> DataFrame:
    """C7 over jobs as groups: a part has a page where its text isn't blank; the parser failed where the page's row says so."""
    rows = results(spark, folder, "job_id", "filename", "full_text", "error").filter("job_id is not null")
    image = ingest.is_image(F.coalesce("filename", F.lit("")), F.lit(None).cast("string"))
    pages = F.when(F.coalesce(normalize.strip(F.col("full_text")), F.lit("")) != "", 1).otherwise(0)
    return pipeline.route_groups(rows.select(F.col("job_id").alias("group_id"), F.col("result_id").alias("part_no"), image.alias("is_image"), pages.alias("n_pages"), F.when(F.col("error").contains("timeout"), F.col("error")).alias("parse_error")))


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.job_status(results(spark, folder, "job_id", "error"))


def catalog_doc_types(spark: SparkSession, folder: str) -> DataFrame:
    """P5 on the catalog table, its smallest term_id standing for a file's name."""
    fields = table(spark, folder, "catalog_terms", "kind", "doc_type", "term_id").filter("kind = 'field'")
    return catalog.doc_types_in_order(fields.groupBy("doc_type").agg(F.lpad(F.min("term_id").cast("string"), 12, "0").alias("file")))


def few_shot_by_page(spark: SparkSession, folder: str) -> DataFrame:
    """Each page with the number and size of the examples of its type; pages of a type without examples have none."""
    kept = few_shot_budget(spark, folder).select(F.element_at(F.split("doc_type", "/"), 1).alias("kind"), "file", "size")
    kept = prompts.few_shot_budget(kept.withColumnRenamed("kind", "doc_type"))
    examples = kept.groupBy(F.col("doc_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    pages = results(spark, folder, "doc_type").withColumn("kind", F.lower(normalize.strip(F.col("doc_type"))))
    return pages.join(examples, "kind", "left").select("result_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_examples"), F.coalesce("size", F.lit(0).cast("bigint")).alias("n_chars"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder, "job_id", "filename", "page_no", "full_text").filter("filename is not null")
    return rows.select("job_id", "result_id", "filename", "page_no", F.when(F.col("result_id") % 4 == 0, "Image/PNG").when(F.col("result_id") % 4 == 1, "application/pdf").alias("content_type"), F.coalesce(F.length("full_text"), F.lit(0)).cast("bigint").alias("bytes"))


def image_detect(spark: SparkSession, folder: str) -> DataFrame:
    name, kind = F.col("filename"), F.col("content_type")
    return uploads(spark, folder).select("result_id", ingest.is_image(name, kind).alias("image"), ingest.media_type(name, kind).alias("media"), normalize.file_stem(name).alias("stem"))


def group_meta(spark: SparkSession, folder: str) -> DataFrame:
    parts = uploads(spark, folder).filter("job_id is not null").select(F.col("job_id").alias("group_id"), F.col("result_id").alias("part_no"), "filename", "content_type", "bytes")
    return ingest.group_meta(parts)


def group_response(spark: SparkSession, folder: str) -> DataFrame:
    rows = uploads(spark, folder).filter("job_id is not null").withColumn("page_no", F.coalesce("page_no", F.lit(0)))
    grouped = pipeline.group_documents(rows, "job_id", ["page_no", "result_id"], F.col("result_id").cast("string"))
    return grouped.select("job_id", F.concat_ws(",", "pages").alias("pages"))


def router_prompt(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    made = prompts.router_prompt(F.concat(F.lit("doc_"), F.col("doc_id")), text, ["invoice", "po", "delivery_note"])
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", prompts.has_input(text, F.lit(None)).alias("has_input"), F.length(made).cast("bigint").alias("n_chars"))


def catalog_templates(spark: SparkSession, folder: str) -> DataFrame:
    fields = catalog.field_catalog(spark, folder)
    ordered = F.array_sort(F.collect_list(F.struct("term_id", "name", "type", "required")))
    text = F.concat_ws(";", F.transform(ordered, lambda f: F.concat_ws(":", f["name"], f["type"], f["required"].cast("string"))))
    return fields.groupBy("doc_type").agg(text.alias("fields"), F.count(F.lit(1)).alias("n_fields"))


def display_values(spark: SparkSession, folder: str) -> DataFrame:
    """S13, S22, S23, P6."""
    rows = results(spark, folder, "full_text", "judge")
    return rows.select("result_id", normalize.percent(F.col("judge.score")).alias("percent"), normalize.display(F.col("judge.notes")).alias("notes"), F.length(normalize.truncate(F.col("full_text"), 60)).cast("bigint").alias("n_shown"))


QUERIES = (
    evaluate_f1_by_doc, evaluate_mismatches, corpus_rollup, auto_evaluate, rename_predictions, values_match_scalar, values_match_container,
    normalize_names, alias_resolve, doc_type_canonical, parse_numbers, parse_dates_compare, parse_dates_validate, string_equal,
    reconcile_catalog, split_extracted, prediction_projection, validate_issues, validate_summary, needs_review, error_issues,
    few_shot_budget, few_shot_by_page, parse_responses, two_attempts, two_attempts_tokens, pipeline_status, pipeline_run, group_routing, job_status, catalog_doc_types, image_detect, group_meta, group_response,
    router_prompt, catalog_templates, display_values,
)
