"""Comparison of predictions with ground truth: counts, precision, recall, F1, mismatches.

Predictions and truth are put under each other and grouped once per document and
field, so that the whole evaluation needs one exchange on doc_id for the fields
and reuses it for the documents. Counts are summed before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import match, normalize


def compare(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per doc_id and field both values, who has the field, and whether they match.

    `predicted` and `truth` have doc_id, field, value_json and ord; each field once per document. The raw texts are
    paired first; null and equal pairs are decided there, numbers are read only of what is left, and dates only
    where numbers don't decide.
    """
    said = predicted.select("doc_id", "field", "value_json", F.lit(1).alias("in_pred"), F.lit(0).alias("in_truth"), F.lit(None).cast("bigint").alias("ord"))
    wanted = truth.select("doc_id", "field", "value_json", F.lit(0).alias("in_pred"), F.lit(1).alias("in_truth"), F.col("ord").cast("bigint").alias("ord"))
    # Only the raw values are exchanged; their readings are worked out behind the exchange, in parallel.
    sides = said.unionByName(wanted).repartition("doc_id")
    own, other = F.col("in_pred") == 1, F.col("in_truth") == 1
    both = sides.groupBy("doc_id", "field").agg(
        F.max("in_pred").alias("in_pred"),
        F.max("in_truth").alias("in_truth"),
        F.max("ord").alias("ord"),
        F.max(F.when(own, F.col("value_json"))).alias("predicted"),
        F.max(F.when(other, F.col("value_json"))).alias("expected"),
    )
    return matching(both)


def matching(both: DataFrame) -> DataFrame:
    """`both` (predicted, expected, ...) with `matched`, rule by rule, each rule read only where those before don't decide."""
    rows = both.withColumns({"_p": normalize.strip(F.col("predicted")), "_e": normalize.strip(F.col("expected"))})
    no_p, no_e = (F.col(c).isNull() | (F.col(c) == "null") for c in ("_p", "_e"))
    rows = rows.withColumn("matched", F.when(no_p | no_e, no_p & no_e).when(F.col("_p") == F.col("_e"), True))
    still = F.col("matched").isNull()
    rows = rows.withColumns({f"{c}_text": F.when(still & ~F.substring(c, 1, 1).isin("[", "{"), normalize.scalar_text(F.col(c))) for c in ("_p", "_e")})
    rows = rows.withColumns({f"{c}_number": F.when(F.col(c) == "true", 1.0).when(F.col(c) == "false", 0.0).otherwise(normalize.parse_number(F.col(f"{c}_text"))) for c in ("_p", "_e")})
    numbers = F.col("_p_number").isNotNull() & F.col("_e_number").isNotNull()
    rows = rows.withColumn("matched", F.when(still & numbers, F.abs(F.col("_p_number") - F.col("_e_number")) <= match.TOLERANCE).otherwise(F.col("matched")))
    texts = still & F.col("_p").startswith('"') & F.col("_e").startswith('"')
    # A date holds a digit and is short; other texts needn't be tried.
    dated = texts & F.col("_p_text").rlike(r"\d.{0,24}$") & F.col("_e_text").rlike(r"\d.{0,24}$")
    rows = rows.withColumns({f"{c}_day": F.when(dated & ~normalize.strip(F.col(f"{c}_text")).rlike(r"^\p{Nd}+$"), normalize.parse_date(F.col(f"{c}_text"))) for c in ("_p", "_e")})
    days = F.col("_p_day").isNotNull() & F.col("_e_day").isNotNull()
    opened = [F.col(c).rlike(r"^[\[{]") | (F.col(c).startswith('"') & F.coalesce(normalize.strip(F.col(f"{c}_text")).rlike(r"^[\[{]"), F.lit(False))) for c in ("_p", "_e")]
    boxes = still & opened[0] & opened[1]
    rows = rows.withColumn("_boxes", F.coalesce(boxes, F.lit(False)))
    rows = rows.withColumn("matched", F.when(still & days, F.col("_p_day") == F.col("_e_day")).when(texts & ~F.col("_boxes"), normalize.same_text(F.col("_p_text"), F.col("_e_text"))).otherwise(F.col("matched")))
    deep = match.containers_match(F.when(F.col("_boxes"), F.col("_p")), F.when(F.col("_boxes"), F.col("_e")))
    rows = rows.withColumn("matched", F.coalesce(F.when(F.col("_boxes"), deep).otherwise(F.col("matched")), F.lit(False)))
    # The generator keeps filters on `matched` from being pushed below, where each would repeat all readings.
    return rows.select(*both.columns, F.explode(F.array("matched")).alias("matched"))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def metrics(counts: DataFrame) -> DataFrame:
    """A2: precision, recall and F1 from tp, fn and fp; empty denominators give 1, and F1 0 where both are 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))

    rows = counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def evaluate(compared: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A1: tp, fn, fp and the metrics per document, or per other columns of the comparison."""
    hit = F.col("matched")
    counts = compared.groupBy(*by).agg(
        count_if((F.col("in_truth") == 1) & hit).alias("tp"),
        count_if((F.col("in_truth") == 1) & ~hit).alias("fn"),
        count_if((F.col("in_pred") == 1) & ~hit).alias("fp"),
    )
    return metrics(counts)


def mismatches(compared: DataFrame) -> DataFrame:
    """A3: the truth's fields that don't match, with both values as they came."""
    return compared.filter((F.col("in_truth") == 1) & ~F.col("matched")).select("doc_id", "ord", "field", "predicted", "expected")


def corpus_rollup(compared: DataFrame) -> DataFrame:
    """Metrics per document type and field, per type, and over all; our own extension. `compared` has doc_type."""
    hit = F.col("matched")
    counts = compared.rollup("doc_type", "field").agg(
        count_if((F.col("in_truth") == 1) & hit).alias("tp"),
        count_if((F.col("in_truth") == 1) & ~hit).alias("fn"),
        count_if((F.col("in_pred") == 1) & ~hit).alias("fp"),
    )
    return metrics(counts)
