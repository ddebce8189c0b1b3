"""Freely entered values mapped to the closest entry of a reference list (problem 6).

A set-similarity join with prefix filter: values and wordings of entries become
sets of letter pairs, ordered by their rarity over both sides. Two sets that are
similar enough must share one of their rarest pairs, so only these prefixes are
joined; length and position of the shared pair rule out more, the Jaccard
similarity of the rest is worked out exactly and the best entry is kept.

Defined results: null and blank values have no row; a value letter for letter in
its list has none either; a value without a close enough entry, or whose list is
empty, gets term 0. Equal scores go to the smaller term_id. Each different value
is matched once, repeated rows don't cost more. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import vocabulary
from ledgerloom.llm.vocabulary import SHORT_FORMS
from ledgerloom.sources.catalog import TYPE_SYNONYMS, synonym_rows
from ledgerloom.tables import checkpoint, table

#: The least Jaccard similarity of two sets of letter pairs.
THRESHOLD = 0.4

# Words around a name that say nothing about it.
FILLERS = frozenset("the doc of for if any a an".split())
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
NOISE = re.compile(r"[\W_]+")


def words_of(value: str) -> list[str]:
    """The words of a name: camel case and separators split, fillers dropped, short forms written out."""
    text = CAMEL.sub(" ", unicodedata.normalize("NFC", value)).lower()
    text = "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in text)
    words = [SHORT_FORMS.get(w, w) for w in text.split()]
    return [w for w in words if w not in FILLERS] or words


def pairs_of(value: str) -> list[str]:
    """Marked first letters, neighbouring letters and letters one apart of each word, so that swapped letters cost little."""
    out = set()
    for word in words_of(value):
        out.add("^" + word[0])
        out.update(word[i : i + 2] for i in range(len(word) - 1))
        out.update(word[i] + word[i + 2] for i in range(len(word) - 2))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def letter_pairs(values: pd.Series) -> pd.Series:
    return values.map(lambda v: pairs_of(v) if v else [])


def ordered(sets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The sets with their members from rare to frequent."""
    rows = sets.select("side", "key", "list", F.explode("pairs").alias("pair")).join(frequencies, "pair")
    return rows.groupBy("side", "key", "list").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "pair"))), lambda x: x["pair"]).alias("pairs"))


def prefix_rows(sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """Each set once per member of its prefix, with the member's place."""
    length = F.size("pairs")
    prefix = F.slice("pairs", F.lit(1), (length - F.ceil(length * F.lit(threshold)) + 1).cast("int"))
    return sets.select(F.col("key").alias(name), "list", F.col("pairs").alias(f"{name}_pairs"), F.posexplode(prefix).alias(f"{name}_at", "pair"))


def map_values(values: DataFrame, phrases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best entry of each value: list, value, term_id, similarity.

    `values` (list, value) are distinct; `phrases` (list, phrase, term_id) hold the wordings of the entries.
    """
    own = values.select(F.lit("v").alias("side"), "list", F.col("value").alias("key"), letter_pairs("value").alias("pairs"))
    entries = phrases.select("list", "phrase").distinct()
    listed = entries.select(F.lit("e").alias("side"), "list", F.col("phrase").alias("key"), letter_pairs("phrase").alias("pairs"))
    both = checkpoint(own.unionByName(listed))
    frequencies = both.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    sets = checkpoint(ordered(both, frequencies))
    left = prefix_rows(sets.filter("side = 'v'"), threshold, "value")
    right = prefix_rows(sets.filter("side = 'e'"), threshold, "phrase")
    n, m = F.size("value_pairs"), F.size("phrase_pairs")
    # Beyond the shared member at most the rest of either set can be shared.
    rest = F.least(n - F.col("value_at"), m - F.col("phrase_at")) + F.least("value_at", "phrase_at")
    need = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - 1e-9)
    pairs = left.join(right, ["list", "pair"]).filter((m >= n * threshold) & (n >= m * threshold) & (rest >= need))
    unique = pairs.dropDuplicates(["list", "value", "phrase"])
    shared = F.size(F.array_intersect("value_pairs", "phrase_pairs"))
    scored = unique.withColumn("similarity", shared / (n + m - shared)).filter(F.col("similarity") >= threshold)
    meant = scored.join(phrases, ["list", "phrase"])
    best = meant.groupBy("list", "value").agg(F.max(F.struct("similarity", (-F.col("term_id")).alias("other"))).alias("best"))
    return best.select("list", "value", (-F.col("best.other")).alias("term_id"), F.col("best.similarity").alias("similarity"))


@F.pandas_udf(T.StringType())
def plain_words(values: pd.Series) -> pd.Series:
    return values.map(lambda v: " ".join(words_of(v)) if v and v.strip() else "")


def listed_terms(terms: DataFrame) -> DataFrame:
    """The catalog with `list`: the document type of a field, nothing for a document type."""
    return terms.select(F.when(F.col("kind") == "field", F.col("doc_type")).otherwise("").alias("list"), "name", "description", "term_id")


#: Entries whose descriptions are read on the driver, at most; a reference list beyond it is an error.
LIST_LIMIT = 100_000


def catalog_phrases(spark: SparkSession, terms: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Wordings of the entries (list, phrase, term_id) by names, descriptions and a table of `synonyms` (list, phrase, name)."""
    own = listed_terms(terms)
    rows = own.limit(LIST_LIMIT + 1).collect()
    if len(rows) > LIST_LIMIT:
        raise ValueError(f"a reference list of more than {LIST_LIMIT} entries")
    found = vocabulary.described([(r.list, r.name, r.description, r.term_id) for r in rows if r.list is not None and r.name])
    out = spark.createDataFrame(found, "list string, phrase string, term_id bigint")
    if synonyms is not None:
        out = out.unionByName(synonyms.join(own.select("list", "name", "term_id"), ["list", "name"]).select("list", "phrase", "term_id"))
    return out.distinct()


def known_synonyms(spark: SparkSession) -> DataFrame:
    """The synonyms of fields and document types that the catalog comes with, as list, phrase, name."""
    rows = [(kind, word.replace("_", " "), name) for kind, word, name in synonym_rows()] + [("", word, name) for word, name in TYPE_SYNONYMS.items()]
    return spark.createDataFrame(rows, "list string, phrase string, name string")


def blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(r"^[\s ​]*$")


def map_column(rows: DataFrame, phrases: DataFrame, names: DataFrame) -> DataFrame:
    """`rows` (list, value, ...) with `term_id`, and `exact` where the value is a name of its list."""
    # The different values are few; written once, they keep the plan short and are not worked out again.
    values = checkpoint(rows.select("list", "value").distinct())
    exact = values.join(names, ["list", "value"])
    others = values.join(names.select("list", "value"), ["list", "value"], "left_anti")
    matched = others.join(map_values(others.filter("list is not null"), phrases), ["list", "value"], "left")
    found = exact.select("list", "value", "term_id", F.lit(True).alias("exact")).unionByName(matched.select("list", "value", F.coalesce("term_id", F.lit(0)).cast("bigint").alias("term_id"), F.lit(False).alias("exact")))
    return rows.join(checkpoint(found), ["list", "value"], "left").withColumns({"term_id": F.coalesce("term_id", F.lit(0).cast("bigint")), "exact": F.coalesce("exact", F.lit(False))})


def p6_found(spark: SparkSession, folder: str, synonyms: DataFrame | None = None) -> DataFrame:
    """The catalog entry that each freely entered value means, 0 for none: src, row_id, pos, term_id.

    `synonyms` (list, phrase, name) may add wordings to those of the catalog and of the data.
    """
    terms = table(spark, folder, "catalog_terms")
    names = listed_terms(terms).select("list", F.col("name").alias("value"), "term_id").dropDuplicates(["list", "value"])
    types = names.filter("list = ''").select("term_id", F.col("value").alias("type_name"))
    responses = table(spark, folder, "routing_responses", "response_id", "result_id", "doc_type", "suggested_fields")
    told = responses.select("response_id", F.explode("suggested_fields").alias("f")).select("response_id", "f.name", "f.description").distinct()
    known = known_synonyms(spark)
    phrases = catalog_phrases(spark, terms, known if synonyms is None else known.unionByName(synonyms))
    results = table(spark, folder, "extraction_results", "result_id", "doc_type").filter("doc_type is not null")
    learned = vocabulary.learned_types(responses.select("result_id", "doc_type"), results, names.filter("list = ''").select(F.col("value").alias("phrase"), "term_id"), plain_words)
    learned = learned.unionByName(vocabulary.learned_names(told, listed_terms(terms), plain_words))
    # What was learned of a wording stands behind what the catalog says of it.
    phrases = checkpoint(phrases.unionByName(learned.join(phrases.select("list", "phrase"), ["list", "phrase"], "left_anti")))

    typed = responses.filter(~blank("doc_type")).select(F.lit("").alias("list"), F.col("doc_type").alias("value"), F.col("response_id").alias("row_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("routing_responses.doc_type").alias("src"))
    meant = map_column(typed.select("list", "value").distinct(), phrases, names)
    of_type = meant.filter("term_id != 0").join(types, "term_id").select(F.col("value").alias("doc_type"), "type_name")

    suggested = (
        responses.select("response_id", "doc_type", F.posexplode("suggested_fields").alias("at", "field"))
        .join(of_type, "doc_type", "left")
        .select(F.coalesce("type_name", F.lit("?")).alias("list"), F.col("field.name").alias("value"), F.col("response_id").alias("row_id"), (F.col("at") + 1).cast("bigint").alias("pos"), F.lit("routing_responses.suggested_fields").alias("src"))
        .filter(~blank("value"))
    )
    entered = (
        table(spark, folder, "extracted_fields", "entry_id", "doc_type", "name")
        .filter(~blank("name"))
        .select(F.coalesce("doc_type", F.lit("?")).alias("list"), F.col("name").alias("value"), F.col("entry_id").alias("row_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("extracted_fields.name").alias("src"))
    )
    rows = map_column(typed.unionByName(suggested).unionByName(entered), phrases, names)
    return rows.filter(~F.col("exact")).select("src", "row_id", "pos", "term_id").distinct()
