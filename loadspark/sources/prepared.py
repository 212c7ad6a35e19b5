"""Versioned tables, feature lists, parameters and trial histories."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_stamp(at: datetime | None = None) -> str:
    """Minute stamp naming one run."""
    return (at or datetime.now()).strftime("%Y-%m-%d_%H-%M")


def write_versioned(df: DataFrame, path: str, run_ts: str, fmt: str = "parquet") -> str:
    """Write one run below `path`; an existing run is never overwritten."""
    target = f"{path}/run_ts={run_ts}"
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(target)
    return target


def latest_run(spark: SparkSession, path: str) -> str:
    """The largest run stamp below `path`, from the file listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stamp = F.regexp_extract("path", r"run_ts=([^/]+)", 1)
    found = listed.select(stamp.alias("s")).where("s != ''").agg(F.max("s")).head()[0]
    if found is None:
        raise FileNotFoundError(f"no run below {path}")
    return found


def read_prepared(spark: SparkSession, path: str, run_ts: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A run written by `write_versioned`, by default the latest."""
    reader = spark.read.format(fmt)
    reader = reader.option("header", True) if fmt == "csv" else reader
    return reader.load(f"{path}/run_ts={run_ts or latest_run(spark, path)}")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small list or map as JSON text, through Spark so that it lands in the shared store."""
    text = spark.createDataFrame([(json.dumps(value),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def write_features(spark: SparkSession, features: Sequence[str], path: str) -> None:
    write_json(spark, list(features), path)


def read_features(spark: SparkSession, path: str) -> list[str]:
    return list(read_json(spark, path))


def write_trials(trials: DataFrame, path: str) -> None:
    """Trial history: parameters as JSON text so that the CSV stays flat."""
    trials.withColumn("params", F.to_json("params")).write.mode("overwrite").option("header", True).csv(path)


def load_data_and_features(
    spark: SparkSession, data_path: str, features_path: str, run_ts: str | None = None
) -> tuple[DataFrame, list[str]]:
    return read_prepared(spark, data_path, run_ts), read_features(spark, features_path)
