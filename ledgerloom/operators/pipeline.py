"""The page pipeline as column stages, and the assembly of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages in their order.
STAGES = ("router", "extractor", "validator", "judge")
#: The message of an image from which nothing was read.
EMPTY_IMAGE = "No fields could be read from the image"


def stage_number(failed_stage: Column, has_type: Column, has_fields: Column, has_validation: Column, has_judge: Column) -> Column:
    """The number of the failed stage, else of the first stage without a result, else 4."""
    failed = F.create_map(*[F.lit(x) for n, s in enumerate(STAGES) for x in (s, n)])[failed_stage]
    return F.coalesce(failed, F.when(~has_type, 0).when(~has_fields, 1).when(~has_validation, 2).when(~has_judge, 3).otherwise(4))


def failure(stage: Column, kind: Column, message: Column) -> Column:
    """A struct of failed_stage and error. kind is call for a failed model call, other for any other error, null for none."""
    validator = stage == "validator"
    return F.struct(
        F.when(kind.isNotNull() & ((kind == "call") | validator), stage).alias("failed_stage"),
        F.when(kind.isNull(), None).when(validator, F.concat(F.lit("Validation failed: "), message)).when(kind == "call", message).otherwise(F.concat(F.lit("Extraction pipeline failed: "), message)).alias("error"),
    )


def run_stages(pages: DataFrame) -> DataFrame:
    """The first failing stage decides; what earlier stages gave is kept, later results are dropped.

    `pages` has per stage `<stage>_kind` (call, other or null) and `<stage>_message`, the results doc_type, n_fields,
    is_valid and score, is_image and has_text, and in strict mode out_of_catalog. Image pages without fields stop at the extractor; text pages go on.
    """
    no_input = ~F.col("has_text") & ~F.col("is_image")
    out = pages.withColumn("_fail", F.when(no_input, F.struct(F.lit("router").alias("failed_stage"), F.lit("Neither text nor image").alias("error"))))
    for stage in STAGES:
        here = failure(F.lit(stage), F.col(f"{stage}_kind"), F.col(f"{stage}_message"))
        out = out.withColumn("_fail", F.when(F.col("_fail").isNull() & F.col(f"{stage}_kind").isNotNull(), F.struct(here["failed_stage"].alias("failed_stage"), here["error"].alias("error"))).otherwise(F.col("_fail")))
        if stage == "extractor":
            empty = F.col("is_image") & (F.coalesce("n_fields", F.lit(0)) == 0)
            out = out.withColumn("_fail", F.when(F.col("_fail").isNull() & empty, F.struct(F.lit("extractor").alias("failed_stage"), F.lit(EMPTY_IMAGE).alias("error"))).otherwise(F.col("_fail")))
        result = {"router": "doc_type", "extractor": "n_fields", "validator": "is_valid", "judge": "score"}[stage]
        out = out.withColumn(result, F.when(F.col("_fail").isNull(), F.col(result)))
    failed = F.col("_fail").isNotNull()
    outside = F.coalesce("out_of_catalog", F.lit(False)) if "out_of_catalog" in pages.columns else F.lit(False)
    review = failed | ~F.coalesce("is_valid", F.lit(False)) | (F.coalesce("score", F.lit(0.0)) < 0.7) | outside
    return out.withColumns({"failed_stage": F.col("_fail.failed_stage"), "error": F.col("_fail.error"), "needs_review": review}).drop("_fail")


def group_documents(pages: DataFrame, group: str, order: list[str], page: Column) -> DataFrame:
    """The pages of each group as an array in page order."""
    rows = pages.select(group, F.struct(*order, page.alias("page")).alias("_r"))
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["page"]).alias("pages"))


# Errors of groups.
NO_PAGES = "No readable pages/text found in the uploaded file(s)."
PARSE_FAILED = "Failed to parse uploaded file(s): "


def route_groups(parts: DataFrame) -> DataFrame:
    """Per group whether its parts go to the model as images or are parsed, and the group's error.

    `parts` has group_id, part_no, is_image, n_pages (of the parsed part) and parse_error. Groups of images only are never
    parsed. Of the others any failed part fails the group, and so does a group without pages.
    """
    by = parts.groupBy("group_id").agg(F.bool_and("is_image").alias("vision"), F.min_by("parse_error", F.when(F.col("parse_error").isNotNull(), F.col("part_no"))).alias("failed"), F.sum(F.coalesce("n_pages", F.lit(0))).alias("pages"), F.count(F.lit(1)).alias("parts"))
    error = F.when(F.col("vision"), None).when(F.col("failed").isNotNull(), F.concat(F.lit(PARSE_FAILED), F.col("failed"))).when(F.col("pages") == 0, F.lit(NO_PAGES))
    documents = F.when(F.col("vision"), F.col("parts")).when(error.isNull(), F.col("pages")).otherwise(0)
    return by.select("group_id", F.when(F.col("vision"), "vision").otherwise("parse").alias("route"), error.alias("error"), documents.cast("bigint").alias("n_documents"))


UUID = r"^(?i)(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def valid_job_id(job_id: Column) -> Column:
    """Whether a job's id is a UUID in any of its written forms."""
    return F.coalesce(job_id.rlike(UUID), F.lit(False))


def job_status(pages: DataFrame) -> DataFrame:
    """Per job (job_id, error) its pages, the failed ones and its status: failed where all pages failed, else done."""
    failed = F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0))
    by = pages.filter("job_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages"), failed.alias("n_failed"))
    return by.select("job_id", valid_job_id(F.col("job_id")).alias("valid_id"), "n_pages", "n_failed", F.when(F.col("n_failed") == F.col("n_pages"), "failed").otherwise("done").alias("status"))
