"""Merging proposed fields with the catalog, splitting answers, and renaming predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.normalize import normalize_name
from ledgerloom.sources.catalog import resolve_alias


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in `order`."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_turn", F.row_number().over(last)).filter("_turn = 1").drop("_turn")


def sorted_pairs(pairs: Column) -> Column:
    """A document's keys and names in order. A document has few fields, so they travel as one array and one exchange does for all lookups."""
    return F.array_sort(F.flatten(F.collect_list(pairs)))


def last_of(known: str, key: str) -> Column:
    """The name of the last entry with that key, null if there is none."""
    return F.try_element_at(F.filter(F.col(known), lambda x: x["key"] == F.col(key)), F.lit(-1))["name"]


def reconcile_catalog(proposed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Proposed fields (doc_id, doc_type, ord, name, description, likely_required) merged with the catalog.

    A proposed field that means a catalog field takes its name and requirement and keeps its description; all
    proposals are kept, also several for one entry. Catalog fields that no proposal means follow in catalog order,
    with part = 1. Document types without a catalog pass through. The catalog side is joined on (doc_type, norm).
    """
    named = proposed.withColumn("norm", resolve_alias(F.col("doc_type"), normalize_name(F.col("name"))))
    entries = catalog.select("doc_type", "norm", F.col("term_id"), F.col("name").alias("c_name"), F.col("required").alias("c_required"), F.col("description").alias("c_description"))
    joined = named.join(entries, ["doc_type", "norm"], "left")
    own = joined.select("doc_id", "doc_type", F.lit(0).alias("part"), F.col("ord").cast("bigint").alias("ord"), F.coalesce("c_name", "name").alias("name"), "description", F.coalesce("c_required", "likely_required").alias("likely_required"))
    documents = proposed.select("doc_id", "doc_type").distinct()
    wanted = documents.join(entries, "doc_type")
    missing = wanted.join(named.select("doc_id", "doc_type", "norm").distinct(), ["doc_id", "doc_type", "norm"], "left_anti")
    more = missing.select("doc_id", "doc_type", F.lit(1).alias("part"), F.col("term_id").alias("ord"), F.col("c_name").alias("name"), F.col("c_description").alias("description"), F.col("c_required").alias("likely_required"))
    return own.unionByName(more)


def split_extracted(entries: DataFrame, suggested: DataFrame) -> DataFrame:
    """Entries (doc_id, doc_type, ord, name, value_json, ...) put under the suggested name they mean.

    Exact names come first, then names equal after synonyms, then after normalising; of several suggested names
    with one meaning the last counts. Entries without a match stay additional under their own name. Null values are
    dropped; of entries that end under one name the last one stays.
    """
    norm = normalize_name(F.col("name"))
    alias = resolve_alias(F.col("doc_type"), norm)
    known = suggested.select("doc_id", "doc_type", F.col("name").alias("s_name"), F.col("ord").alias("s_ord"))
    keys = known.withColumn("norm", normalize_name(F.col("s_name"))).withColumn("alias", resolve_alias(F.col("doc_type"), F.col("norm")))
    pairs = F.transform(F.array_distinct(F.array("norm", "alias")), lambda k: F.struct(F.col("s_ord").alias("ord"), k.alias("key"), F.col("s_name").alias("name")))
    lookup = keys.groupBy("doc_id").agg(sorted_pairs(pairs).alias("_known"), F.collect_set("s_name").alias("_exact"))
    values = entries.filter("value_json is not null and trim(value_json) != 'null'").withColumns({"norm": norm, "alias": alias})
    found = values.join(lookup, "doc_id", "left")
    target = F.coalesce(F.when(F.array_contains("_exact", F.col("name")), F.col("name")), last_of("_known", "alias"), last_of("_known", "norm"))
    named = found.withColumn("_target", target).drop("_known", "_exact")
    named = named.withColumns({"bucket": F.when(F.col("_target").isNotNull(), "extracted").otherwise("additional"), "field": F.coalesce("_target", F.col("name"))})
    return keep_last(named, ["doc_id", "bucket", "field"], ["ord"]).drop("_target", "norm", "alias", "name")


def prediction(split: DataFrame) -> DataFrame:
    """One value per document and field over both buckets; additional ones win."""
    return keep_last(split.withColumn("_late", (F.col("bucket") == "additional").cast("int")), ["doc_id", "field"], ["_late"]).drop("_late")


def rename_predictions(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions (doc_id, doc_type, ord, name, value_json) under the spelling of the truth's names.

    The truth is looked up by the synonym's name first, then by the normalised one. An equal spelling is not
    privileged. Of predictions that end under one name the last stays. Documents without a type keep their names.
    """
    keys = truth.withColumn("norm", normalize_name(F.col("name")))
    keys = keys.withColumn("alias", F.when(F.col("doc_type").isNotNull(), resolve_alias(F.col("doc_type"), F.col("norm"))))
    pairs = F.array(*[F.struct("ord", F.lit(turn).alias("turn"), F.col(key).alias("key"), "name") for turn, key in enumerate(("alias", "norm"))])
    lookup = keys.groupBy("doc_id").agg(sorted_pairs(pairs).alias("_known"))
    own = predicted.withColumn("norm", normalize_name(F.col("name")))
    own = own.withColumn("alias", resolve_alias(F.col("doc_type"), F.col("norm")))
    found = own.join(lookup, "doc_id", "left")
    field = F.when(F.col("doc_type").isNull(), F.col("name")).otherwise(F.coalesce(last_of("_known", "alias"), last_of("_known", "norm"), "name"))
    return keep_last(found.withColumn("field", field).drop("_known"), ["doc_id", "field"], ["ord"]).select("doc_id", "doc_type", "ord", "field", "value_json")
