"""Rule checks of extracted fields: issues, completeness, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import VALIDATE_FORMATS, is_text, parse_date, scalar_text

# Parts of names that hint at dates and amounts.
DATE_HINTS = "date"
AMOUNT_HINTS = "amount|total|balance|price|sum|due"
# Texts of the issues.
NOTHING = "No fields could be extracted from this document at all"
BAD_DATE = "Date does not match a supported format"
NEGATIVE = "Amount should not be negative"
MISSING_OPEN = "Missing field the router flagged as required for this document"


def missing_strict(name: Column) -> Column:
    return F.concat(F.lit("Missing required field '"), name, F.lit("' from catalog"))


def format_messages(field: Column, value_json: Column) -> Column:
    """The messages of one field: a date without a known format, a negative amount."""
    low, text = F.lower(field), scalar_text(value_json)
    bad_date = low.rlike(DATE_HINTS) & is_text(value_json) & parse_date(text, VALIDATE_FORMATS).isNull()
    negative = low.rlike(AMOUNT_HINTS) & ~is_text(value_json) & (F.coalesce(text.try_cast("double"), F.lit(0.0)) < 0)
    return F.array_compact(F.array(F.when(bad_date, F.lit(BAD_DATE)), F.when(negative, F.lit(NEGATIVE))))


def validated(documents: DataFrame, fields: DataFrame, suggested: DataFrame, strict: bool = True) -> DataFrame:
    """A4 to A6, J8, P7 of each document in one grouping: doc_id, listed, n_fields, issues, is_valid, completeness.

    `documents` doc_id; `fields` doc_id, bucket, field, value_json; `suggested` doc_id, field, required. A document
    has few fields, so they travel as arrays and one exchange does for all rules; `listed` tells whether it is among `documents`.
    """
    rows = (
        documents.select("doc_id", F.lit(True).alias("listed"), F.lit(None).cast("struct<bucket:string,field:string,messages:array<string>>").alias("f"), F.lit(None).cast("struct<field:string,required:boolean>").alias("s"))
        .unionByName(fields.select("doc_id", F.struct("bucket", "field", format_messages(F.col("field"), F.col("value_json")).alias("messages")).alias("f")), allowMissingColumns=True)
        .unionByName(suggested.select("doc_id", F.struct("field", F.coalesce("required", F.lit(False)).alias("required")).alias("s")), allowMissingColumns=True)
    )
    by = rows.groupBy("doc_id").agg(F.coalesce(F.max("listed"), F.lit(False)).alias("listed"), F.collect_list("f").alias("fs"), F.collect_list("s").alias("ss"))
    by = by.withColumn("there", F.transform(F.filter("fs", lambda f: f["bucket"] == "extracted"), lambda f: f["field"]))

    def issue(field: Column, message: Column, severity: str) -> Column:
        return F.struct(field.alias("field"), message.alias("message"), F.lit(severity).alias("severity"))

    nothing = F.when(F.col("listed") & (F.size("fs") == 0), F.array(issue(F.lit("*"), F.lit(NOTHING), "error"))).otherwise(F.array())
    missing = F.filter("ss", lambda s: s["required"] & ~F.array_contains("there", s["field"]))
    missing = F.transform(missing, lambda s: issue(s["field"], missing_strict(s["field"]) if strict else F.lit(MISSING_OPEN), "warning"))
    wrong = F.flatten(F.transform("fs", lambda f: F.transform(f["messages"], lambda m: issue(f["field"], m, "warning"))))
    found = F.size(F.filter("ss", lambda s: F.array_contains("there", s["field"])))
    share = F.when(F.size("ss") == 0, F.when(F.size("there") > 0, 1.0).otherwise(0.0)).otherwise(F.bround(found / F.size("ss"), 4))
    return by.select("doc_id", "listed", F.size("fs").cast("bigint").alias("n_fields"), F.concat(nothing, missing, wrong).alias("issues"), share.alias("completeness")).withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def validate_issues(documents: DataFrame, fields: DataFrame, required: DataFrame, strict: bool = True) -> DataFrame:
    """All issues. `documents` doc_id; `fields` doc_id, bucket, field, value_json; `required` doc_id, field."""
    rows = validated(documents, fields, required.select("doc_id", "field", F.lit(True).alias("required")), strict)
    return rows.select("doc_id", F.inline("issues"))


def validate_summary(documents: DataFrame, fields: DataFrame, suggested: DataFrame, strict: bool = True) -> DataFrame:
    """A4, A5: per document whether it is valid, the completeness rounded half to even, and the number of issues. `suggested` has doc_id, field, required."""
    rows = validated(documents, fields, suggested, strict).filter("listed")
    return rows.select("doc_id", "is_valid", "completeness", F.size("issues").cast("bigint").alias("n_issues"))


def needs_review(is_valid: Column, score: Column, strict: bool, out_of_catalog: Column, failed: Column) -> Column:
    """Invalid, scored below 0.7, out of the catalog in strict mode, or failed at any stage."""
    out = F.lit(strict) & F.coalesce(out_of_catalog, F.lit(False))
    return failed | ~F.coalesce(is_valid, F.lit(False)) | (F.coalesce(score, F.lit(0.0)) < 0.7) | out
