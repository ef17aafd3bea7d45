"""Incremental reconciliation of a folder snapshot with the state of the last scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.session import numbered

EVENTS = "kind string, source_id string, path string, previous_path string, sha256 string"
STATE = "source_id string, path string, sha256 string, state string"


def reconcile(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Events of one scan: state (source_id, path, sha256, state), snapshot (path, sha256).

    Paths match first: unchanged needs the same content and an active source, else retry after a failed
    parse or modified. New paths then take over missing sources of equal content one to one, in path
    order; what is left is added or deleted. Deleted sources take no part.
    """
    live = state.filter("state in ('active', 'parse_failed')")
    j = live.select("source_id", F.col("path").alias("old_path"), F.col("sha256").alias("old_sha"), "state").join(snapshot.select("path", "sha256"), F.col("old_path") == F.col("path"), "full_outer")
    both = j.filter("old_path is not null and path is not null")
    kind = F.when((F.col("old_sha") == F.col("sha256")) & (F.col("state") == "active"), "unchanged").when(F.col("state") == "parse_failed", "retry").otherwise("modified")
    none = F.lit(None).cast("string")
    same = both.select(kind.alias("kind"), "source_id", "path", none.alias("previous_path"), "sha256")
    gone = j.filter("path is null").select("source_id", "old_path", "old_sha")
    gone = numbered(gone, "old_sha", "old_path")  # empty files share one content
    new = numbered(j.filter("old_path is null").select("path", "sha256"), "sha256", "path")
    m = new.join(gone, (new["sha256"] == gone["old_sha"]) & (new["n"] == gone["n"]), "full_outer")
    kind = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("moved")
    fresh = F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", "path", "sha256"), 256), 1, 16))
    rest = m.select(kind.alias("kind"), F.coalesce("source_id", fresh).alias("source_id"), F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("previous_path"), F.coalesce("sha256", "old_sha").alias("sha256"))
    return same.unionByName(rest)


def next_state(state: DataFrame, events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The state after a scan. failed (source_id): parses that failed; they keep their id and are retried."""
    e = events.select("source_id", F.col("path").alias("new_path"), F.col("sha256").alias("new_sha"), "kind")
    e = e.join((failed.select("source_id").distinct() if failed is not None else e.limit(0).select("source_id")).withColumn("bad", F.lit(True)), "source_id", "left")
    j = state.join(e, "source_id", "full_outer")
    st = F.when(F.col("kind").isNull(), F.col("state")).when(F.col("kind") == "deleted", "deleted").when(F.col("kind") == "unchanged", F.col("state")).when(F.col("bad"), "parse_failed").otherwise("active")
    return j.select("source_id", F.when(F.col("kind").isin("deleted"), F.col("path")).otherwise(F.coalesce("new_path", "path")).alias("path"), F.coalesce("new_sha", "sha256").alias("sha256"), st.alias("state"))


def status_counts(state: DataFrame) -> DataFrame:
    return state.agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("active", "parse_failed", "deleted")])
