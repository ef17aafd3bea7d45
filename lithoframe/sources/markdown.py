"""Markdown to blocks and pipe tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.operators.audit import markdown_lines
from lithoframe.operators.repairs import DASHES, split_row


def blocks(docs: DataFrame, key: str = "doc_id", md: str = "markdown") -> DataFrame:
    """(key, order_index, kind, heading_level, text, markdown): headings, tables (header and separator rows) and paragraphs."""
    l = markdown_lines(docs, key, md).filter("block is not null")
    b = l.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    first, second = F.trim(F.get("lines", F.lit(0))), F.trim(F.get("lines", F.lit(1)))
    head = first.rlike(r"^#{1,6}\s+\S")
    table = first.rlike(r"^\|.*\|$") & F.coalesce(second.rlike(r"^\|(\s*:?-+:?\s*\|)+$"), F.lit(False))
    text = F.array_join("lines", "\n")
    n = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return b.select(key, n.alias("order_index"), F.when(head, "heading").when(table, "table").otherwise("paragraph").alias("kind"), F.when(head, F.length(F.regexp_extract(first, r"^(#{1,6})", 1))).alias("heading_level"), F.when(head, F.regexp_replace(first, r"^#{1,6}\s+", "")).otherwise(text).alias("text"), text.alias("markdown"))


def table_cells(md: str | None) -> list[dict]:
    """Cells of a pipe table; row 0 is the header, the separator row is left out."""
    rows = [split_row(x) for x in (md or "").splitlines()]
    rows = [r for r in rows if r is not None]
    if len(rows) < 2 or not all(DASHES.fullmatch(c) for c in rows[1]):
        return []
    kept = [rows[0], *rows[2:]]
    return [{"r": i, "c": j, "text": re.sub(r"\\([|\\])", r"\1", c).replace("<br>", "\n").strip()} for i, row in enumerate(kept) for j, c in enumerate(row)]


def pipe_cells(df: DataFrame, md: str, *keys: str) -> DataFrame:
    """(keys, start_row, start_col, text, column_header) of pipe tables; an escaped bar belongs to its cell."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([table_cells(t) for t in texts.to_pylist()], pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32()), ("text", pa.string())])))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    e = df.select(*keys, F.explode(F.arrow_udf(run, "array<struct<r:int,c:int,text:string>>")(md)).alias("_c"))
    return e.select(*keys, F.col("_c.r").alias("start_row"), F.col("_c.c").alias("start_col"), "_c.text", (F.col("_c.r") == 0).alias("column_header"))
