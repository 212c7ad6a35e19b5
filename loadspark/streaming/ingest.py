"""Incremental ingestion: new reading files are appended to the monthly table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.sources.readings import READINGS_SCHEMA, month_of

#: Folder inside the table that holds what has been read; readers of the table skip names with an underscore.
LEDGER = "_ingested"


def ingest_readings(spark: SparkSession, source: str, target: str, checkpoint: str | None = None) -> int:
    """Append the files that arrived in `source` since the last call to the table at `target`; returns the rows added.

    The file stream remembers what it has read in `checkpoint`, by default inside the table itself. So the state lives and moves
    with the data, whatever session or scratch folder the next call has, and the monthly polling loop becomes a call that
    can be repeated or restarted at any time. Every row keeps the file it came from, in column `file`.
    """
    stream = spark.readStream.schema(READINGS_SCHEMA).parquet(source)
    query = (
        stream.select("*", F.col("_metadata.file_name").alias("file"), month_of(F.col("ts")).alias("month"))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint or f"{target.rstrip('/')}/{LEDGER}")
        .partitionBy("month")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """What the table holds: rows by month and source file."""
    rows = spark.read.schema(f"{READINGS_SCHEMA}, file string, month string").parquet(target)
    return rows.groupBy("month", "file").agg(F.count(F.lit(1)).alias("rows"))
