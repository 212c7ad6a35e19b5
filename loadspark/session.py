"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the library."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loadspark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="loadspark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as a parquet table in the shared checkpoint folder and return that table.

    For inputs that are read more than once: they are computed once, later reads take only the columns they need,
    and losing an executor costs a file read rather than a recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_groups(df: DataFrame, *by: str | Column) -> DataFrame:
    """Hash rows by group into the configured number of shuffle partitions.

    Before work whose cost is not in its bytes (Python per group, rows that unfold later), where adaptive execution
    would merge small partitions into a few long tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
