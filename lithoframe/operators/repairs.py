"""Whitelisted repairs: ordered, idempotent, replayable."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.exprs import blank, strip, uuid5
from lithoframe.operators.content import text
from lithoframe.operators.model import Facts, last_blocks, union
from lithoframe.operators.tables import KEY, anchor_copy
from lithoframe.sources.html import html_pipe

REPAIRS = "doc_id string, rule_id string, object_id string, before string, after string, applied boolean, reason string"
FENCE = re.compile(r"\s*(```+|~~~+)")
DASHES = re.compile(r"\s*:?-+:?\s*")


def trailing_space(md: Column) -> Column:
    """Without blanks and tabs at line ends; line ends stay as they are."""
    return F.regexp_replace(md, r"[ \t]+(?=\r?(?:\n|$))", "")


def trailing_space_lines(md: Column) -> Column:
    """How many lines the repair changes."""
    return F.regexp_count(md, F.lit(r"[ \t]+(?=\r?(?:\n|$))")).cast("long")


def split_row(line: str) -> list[str] | None:
    """Cells of a pipe row, or None; a backslash keeps the next bar."""
    s = line.strip()
    if len(s) < 2 or s[0] != "|" or s[-1] != "|":
        return None
    cells, at, k, body = [], 0, 0, s[1:-1]
    while k < len(body):
        if body[k] == "\\":
            k += 2
            continue
        if body[k] == "|":
            cells.append(body[at:k])
            at = k + 1
        k += 1
    return [*cells, body[at:]]


def align_separators(md: str | None) -> str | None:
    """Give each separator row of a pipe table its header's number of columns; fenced code is left alone."""
    if md is None or "|" not in md:
        return md
    lines = md.splitlines(keepends=True)
    out, fenced = list(lines), False
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r\n")
        if FENCE.match(line):
            fenced = not fenced
            continue
        cells = None if fenced or not i else split_row(line)
        if not cells or not all(DASHES.fullmatch(c) for c in cells):
            continue
        head = split_row(lines[i - 1].rstrip("\r\n"))
        if head and len(head) != len(cells):
            styles = (cells + ["---"] * len(head))[: len(head)]
            out[i] = "|" + "|".join(c.strip() or "---" for c in styles) + "|" + raw[len(line) :]
    return "".join(out)


def separators_aligned(md: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([align_separators(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.when(md.contains("|"), F.arrow_udf(run, "string")(md)).otherwise(md)


TEXT_REPAIRS = (("QL-RPR-001", trailing_space), ("QL-RPR-002", separators_aligned))


def affected_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, rule_id, block_id): blocks that each text repair would change by itself."""
    return union(*[blocks.filter(fix(F.col("markdown")) != F.col("markdown")).select("doc_id", F.lit(r).alias("rule_id"), "block_id") for r, fix in TEXT_REPAIRS])


def record(df: DataFrame, rule_id: str, object_id: Column, before: Column, after: Column, applied: Column | None = None, reason: Column | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(rule_id).alias("rule_id"), object_id.alias("object_id"), before.alias("before"), after.alias("after"), (F.lit(True) if applied is None else applied).alias("applied"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))


def repair_text(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents with both text repairs in order, and the records of those that changed something."""
    records = []
    for rule_id, fix in TEXT_REPAIRS:
        step = documents.withColumn("_after", fix(F.col("markdown")))
        records.append(record(step.filter("_after <> markdown"), rule_id, F.lit("markdown"), F.col("markdown"), F.col("_after")))
        documents = step.withColumn("markdown", F.col("_after")).drop("_after")
    return documents, union(*records)


def first_replaced(whole: Column, old: Column, new: Column) -> Column:
    """The first occurrence of old replaced."""
    at = F.locate(old, whole) if not isinstance(old, Column) else F.call_function("instr", whole, old)
    return F.when((old == "") | (at == 0), whole).otherwise(F.concat(F.substring(whole, F.lit(1), at - 1), new, F.substring(whole, at + F.length(old), F.length(whole))))


def fold_replacements(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """documents whose Markdown has each (old, new) of pairs (doc_id, ord, old, new) replaced once, in order."""
    p = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "old", "new"))).alias("_p"))
    d = documents.join(p, "doc_id", "left")
    folded = F.aggregate(F.col("_p"), F.col("markdown"), lambda a, x: first_replaced(a, x["old"], x["new"]))
    return d.withColumn("markdown", F.coalesce(folded, F.col("markdown"))).drop("_p")


def html_to_pipe(f: Facts, rendered: DataFrame) -> tuple[Facts, DataFrame]:
    """Tables whose Markdown is still HTML, or whose HTML is in the document, get pipe Markdown in table, block and document.

    rendered: (doc_id, table_id, pipe). The block's old Markdown is replaced, else the table's HTML. Without a table block,
    a rendering, or its text in the document, the repair is recorded as rejected.
    """
    html, md = F.coalesce("html", F.lit("")), F.coalesce("t.markdown", F.lit(""))
    b = last_blocks(f.blocks, kind="kind", order_index="order_index", block_md="markdown")
    t = f.tables.alias("t").filter(html != "").join(b, ["doc_id", "block_id"], "left").join(rendered, ["doc_id", "table_id"], "left").join(f.documents.select("doc_id", F.col("markdown").alias("doc_md")), "doc_id")
    t = t.filter(blank(md) | F.lower(md).contains("<table") | F.col("doc_md").contains(F.col("html")))
    old = F.when((F.coalesce("block_md", F.lit("")) != "") & F.col("doc_md").contains(F.col("block_md")), F.col("block_md")).when(F.col("doc_md").contains(F.col("html")), F.col("html"))
    reason = F.when(F.col("kind").isNull() | (F.col("kind") != "table"), "no table block").when(F.col("pipe").isNull() | blank(F.col("pipe")), "cells can't be rendered").when(old.isNull(), "text isn't in the document")
    t = t.withColumn("old", old).withColumn("reason", reason)
    ok = t.filter("reason is null")
    records = record(t, "QL-RPR-003", F.col("table_id"), F.coalesce("old", "html"), F.col("pipe"), F.col("reason").isNull(), F.col("reason"))
    new = ok.select("doc_id", "table_id", "block_id", F.col("pipe").alias("_pipe"))
    tables = f.tables.join(new.select("doc_id", "table_id", "_pipe"), KEY, "left").withColumn("markdown", F.coalesce("_pipe", "markdown")).drop("_pipe")
    blocks = f.blocks.join(new.groupBy("doc_id", "block_id").agg(F.max("_pipe").alias("_pipe")), ["doc_id", "block_id"], "left").withColumn("markdown", F.coalesce("_pipe", "markdown")).drop("_pipe")
    docs = fold_replacements(f.documents, ok.select("doc_id", F.struct(F.coalesce("order_index", F.lit(-1)), "table_id").alias("ord"), "old", F.col("pipe").alias("new")))
    return Facts(docs, blocks, tables, f.cells, f.grid, f.assets, f.artifacts, f.capabilities), records


def restore_line_breaks(f: Facts) -> tuple[Facts, DataFrame]:
    """Text cells whose raw value has line ends that the text lost get them back; their tables are rendered anew.

    Only tables with a grid that are rendered by copying anchors. A table whose block isn't a table block or whose
    Markdown isn't in the document keeps its cells and is recorded as rejected.
    """
    nl = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    raw = nl("raw_value")
    lost = (F.coalesce("value_type", F.lit("")) == "string") & raw.contains("\n") & (strip(raw) != strip(nl("text")))
    copied = f.tables.filter("markdown_rendering = 'anchor_copy'").select(*KEY).join(f.grid.select(*KEY).distinct(), KEY, "left_semi")
    hit = f.cells.filter(lost).select(*KEY).distinct().join(copied, KEY, "left_semi")
    found = f.cells.join(hit, KEY, "left_semi").withColumn("text", F.when(lost, raw).otherwise(F.col("text")))
    fresh = anchor_copy(f.grid.join(hit, KEY, "left_semi"), found).withColumnRenamed("rendered", "_new")
    b = last_blocks(f.blocks, kind="kind", block_md="markdown")
    t = f.tables.join(hit.withColumn("_hit", F.lit(True)), KEY, "left").join(fresh, KEY, "left").join(f.documents.select("doc_id", F.col("markdown").alias("_doc")), "doc_id", "left").join(b, ["doc_id", "block_id"], "left")
    old = F.col("block_md")
    usable = F.col("_hit") & (F.coalesce("_new", F.lit("")) != "") & (F.col("kind") == "table") & (old != "") & F.col("_doc").contains(old)
    t = t.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    records = record(t.filter("_hit"), "QL-RPR-004", F.col("table_id"), F.coalesce("block_md", "markdown"), F.col("_new"), F.col("_ok"), F.when(~F.col("_ok"), "table can't be found or rendered"))
    ok = t.filter("_ok")
    fixed_cells = f.cells.join(ok.select(*KEY).withColumn("_k", F.lit(True)), KEY, "left").withColumn("text", F.when(lost & F.col("_k"), raw).otherwise(F.col("text"))).drop("_k")
    docs = fold_replacements(f.documents, ok.select("doc_id", F.struct(F.lit(0), "table_id").alias("ord"), old.alias("old"), F.col("_new").alias("new")))
    blocks = f.blocks.join(ok.groupBy("doc_id", "block_id").agg(F.max("_new").alias("_b")), ["doc_id", "block_id"], "left").withColumn("markdown", F.coalesce("_b", "markdown")).drop("_b")
    tables = t.withColumn("markdown", F.when(F.col("_ok"), F.col("_new")).otherwise(F.col("markdown"))).select(*f.tables.columns)
    return Facts(docs, blocks, tables, fixed_cells, f.grid, f.assets, f.artifacts, f.capabilities), records


def sync_blocks(f: Facts) -> Facts:
    """Both text repairs on every block, then each table's Markdown becomes its block's."""
    md = F.col("markdown")
    for _, fix in TEXT_REPAIRS:
        md = fix(md)
    blocks = f.blocks.withColumn("markdown", md)
    b = last_blocks(blocks, _k="kind", _b="markdown").filter("_k = 'table'")
    tables = f.tables.join(b, ["doc_id", "block_id"], "left").withColumn("markdown", F.coalesce("_b", "markdown")).select(*f.tables.columns)
    return Facts(f.documents, blocks, tables, f.cells, f.grid, f.assets, f.artifacts, f.capabilities)


def repair_all(f: Facts) -> tuple[Facts, DataFrame]:
    """All four repairs in order: Markdown, HTML tables, line ends of cells, then blocks and tables in step."""
    docs, records = repair_text(f.documents)
    fixed = Facts(docs, f.blocks, f.tables, f.cells, f.grid, f.assets, f.artifacts, f.capabilities)
    if f.tables.isEmpty():
        return sync_blocks(fixed), with_repair_ids(records)
    rendered = f.tables.filter("html <> ''").select(*KEY, html_pipe(F.col("html")).alias("pipe"))
    fixed, converted = html_to_pipe(fixed, rendered)
    fixed, restored = restore_line_breaks(fixed)
    return sync_blocks(fixed), with_repair_ids(union(records, converted, restored))


def with_repair_ids(records: DataFrame) -> DataFrame:
    return records.withColumn("repair_id", uuid5(text("repair|", F.col("doc_id"), "|", F.col("rule_id"), "|", F.sha2(F.coalesce("before", F.lit("")), 256))))


def replay(records: DataFrame) -> DataFrame:
    """Text repair records with ok: does the rule still turn before into after?"""
    again = F.lit(None).cast("string")
    for rule_id, fix in TEXT_REPAIRS:
        again = F.when(F.col("rule_id") == rule_id, fix(F.col("before"))).otherwise(again)
    return records.withColumn("ok", again.eqNullSafe(F.col("after")))


def rollback(current: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, rule_id, markdown, undone): the state before a repair, only where the current state is the one after it."""
    j = records.join(current.select("doc_id", F.col("markdown").alias("_now")), "doc_id")
    same = F.col("_now") == F.col("after")
    return j.select("doc_id", "rule_id", F.when(same, F.col("before")).otherwise(F.col("_now")).alias("markdown"), same.alias("undone"))
