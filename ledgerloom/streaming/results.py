"""Page results as a stream: normalised as they arrive, and counted in windows of their own time.

The reference has no streaming; this lets the batch operators' column functions run on arriving files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.validate import needs_review
from ledgerloom.sources.catalog import canonical_type


def read_results(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; its schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def reviewed(results: DataFrame) -> DataFrame:
    """Each page with its canonical type and whether it needs a review; works on streams and tables alike."""
    kind = canonical_type(F.col("doc_type"))
    failed = F.col("failed_stage").isNotNull() | F.col("error").isNotNull()
    review = needs_review(F.col("validation.is_valid"), F.col("judge.score"), True, kind["out_of_catalog"], failed)
    return results.select("result_id", "extracted_at", kind["doc_type"].alias("doc_type"), review.alias("review"))


def review_rate(results: DataFrame, late: str = "100 days", width: str = "7 days") -> DataFrame:
    """Pages and reviews per type and window; a page counts once by result_id, and later than `late` not at all."""
    pages = reviewed(results).withColumn("extracted_at", F.col("extracted_at").cast("timestamp")).withWatermark("extracted_at", late)
    once = pages.dropDuplicatesWithinWatermark(["result_id"]) if results.isStreaming else pages.dropDuplicates(["result_id"])
    window = F.window("extracted_at", width)
    return once.groupBy(window.alias("w"), "doc_type").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("review").cast("int")).alias("n_review")).select(F.col("w.start").alias("since"), "doc_type", "n_pages", "n_review")


def write_rates(rates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended to Parquet files exactly once; `checkpoint` must be a folder that all machines share."""
    return rates.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
