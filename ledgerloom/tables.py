"""Reading the project's tables and spreading work over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named table of `folder`, cut down to `columns` at the scan."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Python-heavy operators run one task per partition; a scan of one small file
    would leave the other cores idle. Inputs that already have enough
    partitions pass through without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(2 * cores)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint.

    The folder is the cluster's `spark.checkpoint.dir`. Where that is unset a local
    session, as in tests, gets a folder of its own; on a cluster it is an error.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
        context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


#: The record tables with their text column, the key column and the name of their JSON column.
RECORD_TABLES = ("invoices", "purchase_orders", "delivery_notes")


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The three record tables under each other, with `src` naming the table."""
    parts = [
        table(spark, folder, name, "record_id", *columns).withColumn("src", F.lit(name))
        for name in RECORD_TABLES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
