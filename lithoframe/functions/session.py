"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a local session, as elsewhere executors don't see it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lithoframe-"))
    return spark.sparkContext.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read from there.

    A result that several plans read is computed once, its plan isn't part of theirs, each of them reads only the
    columns that it needs, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, order: str, name: str = "n") -> DataFrame:
    """df with the place of each row among those of its key, from 1, by order (distinct within a key).

    Rows are dealt out by ranges of (key, order), so that one very frequent key is spread over many tasks; a place is the
    rank within the range plus the key's rows in earlier ranges. The ranges are written first, so that they hold still.
    """
    r = materialized(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    counts = r.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), before.alias("_before"))  # a row for each key and range
    j = r.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    return j.withColumn(name, (F.col("_before") + own).cast("int")).drop("_part", "_key", "_p", "_before")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys and kept: aggregations and joins on them, or on more columns, need no exchange.

    What an executor held is dealt out again if the executor is lost.
    """
    return df.repartition(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """df as a table of n buckets by key in the shared folder: its readers need no exchange for what goes by key, or by key and more.

    df has to be dealt out by key over n partitions (else each task writes n files). Nothing is held by executors.
    The session's setting that lets joins on more columns than the key use the buckets stays set.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"dealt_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).options(path=f"{shared_folder(spark)}/{name}", compression="zstd").saveAsTable(name)
    return spark.table(name)


def near(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """df dealt out as tables of n buckets by key are, so that they meet without another exchange of theirs (n: None: as it is)."""
    return df.repartition(n, key) if n else df
