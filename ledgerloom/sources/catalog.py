"""Catalogs, synonyms, few-shot examples and ground truth as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import file_stem, normalize_name, strip
from ledgerloom.tables import table

# Synonyms of field names, by document type and catalog name.
SYNONYMS = {
    "invoice": {
        "invoice_date": "order_date issue_date date billing_date transaction_date",
        "payment_due_date": "due_date payment_due pay_by_date",
        "seller_name": "vendor_name merchant_name supplier_name from_name company_name",
        "bill_to_name": "bill_to customer_name to_name buyer_name client_name",
        "total_amount": "grand_total amount_due total net_total invoice_total",
        "tax_amount": "vat gst vat_amount gst_amount sales_tax",
        "invoice_number": "invoice_no invoice_id inv_no inv_number receipt_number",
    },
    "po": {
        "order_date": "po_date issue_date date purchase_date",
        "supplier_name": "vendor_name seller_name merchant_name from_name",
        "buyer_name": "ship_to bill_to to_name customer_name purchaser_name",
        "total_amount": "grand_total total order_total net_total",
        "payment_terms": "terms pay_terms",
        "po_number": "po_no po_id purchase_order_number order_number order_no",
    },
    "delivery_note": {
        "delivery_note_number": "do_number do_no dn_number dn_no delivery_order_number delivery_no",
        "delivered_by": "courier carrier driver transporter logistics_provider",
        "recipient_name": "ship_to deliver_to consignee receiver_name customer_name",
        "sender_name": "ship_from shipper from_name dispatch_from",
        "total_weight": "gross_weight weight net_weight package_weight",
        "notes": "remarks comments special_instructions instructions",
    },
}
# Other names of document types in strict mode.
TYPE_SYNONYMS = {"purchase_order": "po", "purchase order": "po", "p.o.": "po", "invoices": "invoice", "delivery note": "delivery_note", "dn": "delivery_note"}
#: Document types of the catalog.
CATALOG_TYPES = ("invoice", "po", "delivery_note")


def synonym_rows() -> list[tuple[str, str, str]]:
    return [(t, word, name) for t, fields in SYNONYMS.items() for name, words in fields.items() for word in words.split()]


def synonyms(spark: SparkSession) -> DataFrame:
    """doc_type, synonym, canonical."""
    return spark.createDataFrame(synonym_rows(), "doc_type string, synonym string, canonical string")


def resolve_alias(doc_type: Column, name: Column) -> Column:
    """The catalog name of an already normalised name, or the name itself. The lookup is a literal map, no join."""
    pairs = [F.lit(x) for t, word, canonical in synonym_rows() for x in (f"{t}|{word}", canonical)]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("|", F.lower(strip(doc_type)), name)], name)


def canonical_type(doc_type: Column, allowed: tuple[str, ...] = CATALOG_TYPES) -> Column:
    """A struct of the strict-mode document type and whether it is out of the catalog."""
    plain = F.lower(strip(doc_type))
    known = {t: t for t in allowed} | {k: v for k, v in TYPE_SYNONYMS.items() if v in allowed and k not in allowed}
    found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[plain]
    return F.struct(F.coalesce(found, doc_type).alias("doc_type"), found.isNull().alias("out_of_catalog"))


def field_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """doc_type, ord, name, norm, type, required, description of the catalog table's fields; of equal norms the last stays."""
    fields = table(spark, folder, "catalog_terms").filter("kind = 'field'")
    from pyspark.sql.window import Window

    named = fields.select(
        "doc_type",
        "term_id",
        "name",
        normalize_name(F.col("name")).alias("norm"),
        F.col("value_type").alias("type"),
        F.coalesce("required", F.lit(False)).alias("required"),
        "description",
    )
    last = Window.partitionBy("doc_type", "norm").orderBy(F.desc("term_id"))
    return named.withColumn("turn", F.row_number().over(last)).filter("turn = 1").drop("turn")


def read_catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """IO6 and IO7: catalog JSON files as rows; unreadable files and fields without a name are left out.

    doc_type comes from the file's content or else from its name; blank texts become null.
    """
    schema = "doc_type string, description string, fields array<struct<name:string,type:string,required:boolean,likely_required:boolean,validation_rule:string>>, _bad string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).filter("_bad is null and fields is not null")
    return (
        rows.select(F.coalesce(F.nullif(strip(F.col("doc_type")), F.lit("")), F.regexp_replace(file_stem(F.col("file")), "_fields$", "")).alias("doc_type"), "file", F.posexplode("fields").alias("ord", "f"))
        .select("doc_type", "file", "ord", strip(F.col("f.name")).alias("name"), F.nullif(strip(F.col("f.type")), F.lit("")).alias("type"), F.coalesce("f.required", "f.likely_required", F.lit(False)).alias("required"), F.nullif(strip(F.col("f.validation_rule")), F.lit("")).alias("validation_rule"))
        .filter("name is not null and name != ''")
    )


def read_few_shot_files(spark: SparkSession, path: str) -> DataFrame:
    """IO8: example JSON files in folders named after their document type: doc_type, file, output."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    output = F.coalesce(F.get_json_object("json", "$.output"), F.get_json_object("json", "$.fields"))
    return rows.select(F.lower(F.element_at(F.split("file", "/"), -2)).alias("doc_type"), "file", output.alias("output")).filter("output is not null")


def ground_truth(rows: DataFrame, stems: DataFrame, stem_column: str = "file_stem") -> DataFrame:
    """IO9: `rows` (filename, ...) with the truth of the file of that stem, null where there is none."""
    return rows.withColumn(stem_column, file_stem(F.col("filename"))).join(stems, stem_column, "left")


# The templates shown where a catalog has none: type, then name, type of value and requirement of its fields.
FALLBACK = [
    ("invoice", [("invoice_number", "string", True), ("invoice_date", "date", True), ("total_amount", "number", True)]),
    ("po", [("po_number", "string", True), ("order_date", "date", True), ("total_amount", "number", True)]),
]


def visible_templates(fields: DataFrame, strict: bool) -> DataFrame:
    """IO6, P10: the catalog's fields (doc_type, file, ord, name, type, required); without any, none in strict mode and two built-in templates in open mode."""
    rows = [(kind, f"{kind}_fields.json", n, *f) for kind, own in FALLBACK for n, f in enumerate(own)]
    built_in = fields.sparkSession.createDataFrame([] if strict else rows, "doc_type string, file string, ord int, name string, type string, required boolean")
    own = fields.select(*built_in.columns)
    return own.unionByName(built_in.join(own.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def fields_of_type(fields: DataFrame, doc_types: DataFrame) -> DataFrame:
    """The fields of each of `doc_types` (doc_type), without regard to case and outer blanks; of several files of a type the first in name order counts."""
    plain = F.lower(strip(F.col("doc_type")))
    first = fields.withColumn("_type", plain).groupBy("_type").agg(F.min("file").alias("file"))
    kept = fields.withColumn("_type", plain).join(first, ["_type", "file"], "left_semi").drop("doc_type")
    return doc_types.select("doc_type").distinct().withColumn("_type", plain).join(kept, "_type").drop("_type")


def doc_types_in_order(fields: DataFrame) -> DataFrame:
    """P5: the document type of each file with its place in the order of file names; types of several files stay several."""
    files = fields.groupBy("file").agg(F.first("doc_type").alias("doc_type"))
    before = files.select(F.col("file").alias("_other"))
    # A catalog's files are few; counting those before needs no window over all rows.
    placed = files.join(before, F.col("_other") < F.col("file"), "left").groupBy("file", "doc_type").agg(F.count("_other").alias("place"))
    return placed.select("place", "doc_type", "file")


def file_counts(paths: DataFrame) -> DataFrame:
    """The number of JSON files (path) per folder of a knowledge base."""
    return paths.filter(F.lower("path").endswith(".json")).groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))
