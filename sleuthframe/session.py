"""Session helpers: UTC, the shared checkpoint folder, table loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

TASK_ROWS = 50_000

#: Spark's own removal of shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps of the library are UTC; the session has to agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where none is set, one under the warehouse."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def durable(df: DataFrame, clean: bool = False) -> DataFrame:
    """Cut lineage through a table in the shared folder: computed once, and it survives lost executors.

    ``clean`` has Spark remove the shuffle files of the write at its end, not when the driver's
    collector comes to them: what comes after does not add to the disk of what came before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean and kept is None:
            spark.conf.unset(CLEANUP)
        elif clean:
            spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Read one Parquet table; zone-less timestamps are taken as UTC instants.

    ``spread`` is for heavy work per row: the table is dealt out over all cores, and over
    more tasks the more rows it has, so that a task's time and memory do not grow with it.
    Tables that have enough splits stay.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
    if not spread:
        return df
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-df.count() // (TASK_ROWS * cores)))  # whole rounds of all cores; the count comes from the footers
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
