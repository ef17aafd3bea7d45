"""Reconciliation as a stream: each micro-batch is one scan; state and event log are tables.

A batch's state goes to a folder named by its number, so a batch that runs again after a failure reads
the state before it and overwrites its own results: the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lithoframe.operators.lifecycle import STATE, next_state, reconcile


def _last_state(spark: SparkSession, root: str, before: int) -> DataFrame:
    """The state after the last finished batch: one listing of the folder of states."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state/*/_SUCCESS")
    done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    numbers = [int(x.getPath().getParent().getName()) for x in done]
    last = max((n for n in numbers if n < before), default=None)
    return spark.createDataFrame([], STATE) if last is None else spark.read.schema(STATE).parquet(f"{root}/state/{last}")


def start(scans: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run reconciliation over a stream of snapshots (path, sha256); results under root/state and root/events."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        # a path listed twice in a scan counts once, the greatest content wins
        snapshot = df.groupBy("path").agg(F.max("sha256").alias("sha256"))
        old = _last_state(spark, root, n)
        events = reconcile(old, snapshot).persist()
        events.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/events/batch={n}")
        next_state(old, events).write.mode("overwrite").parquet(f"{root}/state/{n}")
        events.unpersist()

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
