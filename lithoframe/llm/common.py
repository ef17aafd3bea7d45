"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. A temporary one only in a local session: elsewhere executors don't see it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lithoframe-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: lineage ends, executors may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions give at most about `each` rows to a task, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each), 1)


ARROW_ROWS, ARROW_BYTES = 1000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ARROW_ROWS rows and about ARROW_BYTES: both sides hold a batch as a whole."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.sub(r"\D", "", str(spark.conf.get(key)))
        if not 0 < int(now or 0) <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text"):
    """A text column's UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def to_batch(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))


#: A space before white space or at the end: such texts can't be cut before every space.
_ODD = re.compile("(?: (?:[\\s\x1c-\x1f\x85]|$))")


def units(text: str) -> list[str] | None:
    """Cut a text before each space that starts a word, or None where the spacing forbids it.

    The pre-token pattern of the byte-level vocabularies lets a space join only what follows, so no
    pre-token crosses such a cut, and a unit's pre-tokens are the same alone as in the whole text.
    """
    if _ODD.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Memo(dict):
    """A bounded memo of a pure function of short strings; it empties itself when full."""

    def __init__(self, make: Callable[[str], object], limit: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back (columnar and compressed)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


FEW = 200_000  # rows that are broadcast at most


def few(rows: DataFrame) -> DataFrame:
    """rows (cut from their lineage) as a side of a join: broadcast where they are FEW at most."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself.

    Shuffle files that only they needed go when the driver collects its garbage, which else may take half an hour.
    """
    spark.sparkContext._jvm.System.gc()
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
