"""Joins with an order of preference, positional joins and checks on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import is_sha256, safe_path


def match_sheets(payloads: DataFrame, sheets: DataFrame, book: str = "book") -> DataFrame:
    """(book, table_no, sheet, how): payload tables (name, rows, cols) to sheets (sheet, name, rows, visible, cols), each once.

    By name first, repeated names in order; then where one table and one sheet are left that fit each
    other's size and nothing else's; then the last one left of both. Each step takes out what it used.
    """

    def left(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
        return df.join(used.select(book, key), [book, key], "left_anti")

    t = payloads.withColumn("_n", F.row_number().over(Window.partitionBy(book, "name").orderBy("table_no")))
    s = sheets.withColumn("_n", F.row_number().over(Window.partitionBy(book, "name").orderBy("sheet")))
    named = t.join(s.select(book, "name", "_n", "sheet"), [book, "name", "_n"]).select(book, "table_no", "sheet", F.lit("name").alias("how"))
    t2, s2 = left(payloads, named, "table_no"), left(sheets, named, "sheet")
    fit = t2.alias("t").join(s2.alias("s"), (F.col(f"t.{book}") == F.col(f"s.{book}")) & (F.col("t.cols") == F.col("s.cols")) & ((F.col("t.rows") == F.col("s.rows")) | (F.col("t.rows") == F.col("s.visible")))).select(F.col(f"t.{book}").alias(book), "table_no", "sheet")
    one = fit.withColumn("_a", F.count("*").over(Window.partitionBy(book, "table_no"))).withColumn("_b", F.count("*").over(Window.partitionBy(book, "sheet"))).filter("_a = 1 and _b = 1")
    sized = one.select(book, "table_no", "sheet", F.lit("size").alias("how"))
    t3, s3 = left(t2, sized, "table_no"), left(s2, sized, "sheet")
    alone = lambda df, c: df.groupBy(book).agg(F.max(c).alias(c), F.count("*").alias("_k")).filter("_k = 1").drop("_k")
    last = alone(t3, "table_no").join(alone(s3, "sheet"), book).select(book, "table_no", "sheet", F.lit("last").alias("how"))
    return named.unionByName(sized).unionByName(last)


def positional(cells: DataFrame, source_rows: DataFrame, *keys: str) -> DataFrame:
    """cells (keys, row) with the source row at that place of source_rows (keys, rows array)."""
    pos = source_rows.select(*keys, F.posexplode("rows").alias("row", "source_row"))
    return cells.join(pos, [*keys, "row"], "left")


def paired_by_ordinal(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """a and b (both with key) joined by ordinal, for keys that have as many of both; none otherwise."""
    w = Window.partitionBy(key)
    x = a.withColumn("_i", F.row_number().over(w.orderBy(order_a))).withColumn("_k", F.count("*").over(w))
    y = b.withColumn("_i", F.row_number().over(w.orderBy(order_b))).withColumn("_k", F.count("*").over(w))
    return x.join(y, [key, "_i", "_k"]).drop("_i", "_k")


def last_wins(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each lower-cased key, the last in order."""
    k = F.lower(F.col(key))
    w = Window.partitionBy("_key").orderBy(F.desc(order))
    return items.withColumn("_key", k).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_key")


def contract_errors(bbox: Column, sha: Column, path: Column, page: Column, confidence: Column) -> Column:
    """The invariants that a record breaks, as sorted codes."""
    inside = F.forall(bbox, lambda v: (v >= 0) & (v <= 1000)) & (F.size(bbox) == 4)
    return F.array_sort(F.array_compact(F.array(F.when(bbox.isNotNull() & ~inside, "bbox"), F.when(sha.isNotNull() & ~is_sha256(sha), "sha256"), F.when(path.isNotNull() & ~safe_path(path), "path"), F.when(page < 1, "page"), F.when((confidence < 0) | (confidence > 1), "confidence"))))


def filled(existing: Column, defaults: Column) -> Column:
    """A map with defaults for the keys that it lacks."""
    keys = F.map_keys(existing)
    return F.map_from_entries(F.concat(F.map_entries(existing), F.map_entries(F.map_filter(defaults, lambda k, v: ~F.array_contains(keys, k)))))


#: fixed values: (type, code) of what an output can lack, in order
PROBLEMS = (
    ("parser_problem", "parser_failed"), ("parser_problem", "successful_status_but_empty_content"), ("normalization_problem", "native_tables_not_structured_in_markdown_handoff"), ("normalization_problem", "native_pictures_not_referenced_in_markdown_handoff"),
    ("normalization_problem", "split_parts_lack_root_merged_structure"), ("quality_rule_gap", "embedded_data_uri_requires_externalization_or_rejection"), ("quality_rule_gap", "missing_local_asset_reference_requires_blocking_rule"),
)
#: fixed values: codes of signals that only call for a look
SIGNALS = ("low_exact_anchor_coverage_proxy", "low_native_page_evidence_coverage")


def attributed() -> Column:
    """array<struct<type, code>> of an output's problems. A failed parser has that one alone.

    Reads parser_success, is_empty, table_count, html_tables, pipe_rows, pictures, references, split, merged, data_uris and
    missing_references; a missing number counts as none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = yes("parser_success")
    holds = (~ok, ok & yes("is_empty"), ok & (n("table_count") > 0) & (n("html_tables") == 0) & (n("pipe_rows") == 0), ok & (n("pictures") > 0) & (n("references") == 0), ok & yes("split") & ~yes("merged"), ok & (n("data_uris") > 0), ok & (n("missing_references") > 0))
    return F.array_compact(F.array(*[F.when(h, F.struct(F.lit(t).alias("type"), F.lit(c).alias("code"))) for h, (t, c) in zip(holds, PROBLEMS, strict=True)]))


def signals() -> Column:
    """Codes that call for a look: few of the source's anchors found (proxy_available, coverage, is_empty), few pages seen (ext, source_pages, page_coverage)."""
    anchors = F.coalesce(F.col("proxy_available") & (F.col("coverage") < 0.5) & ~F.coalesce("is_empty", F.lit(False)), F.lit(False))
    pages = F.coalesce((F.col("ext") == ".pdf") & (F.col("source_pages") > 1) & (F.col("page_coverage") < 0.8), F.lit(False))
    return F.array_compact(F.array(*[F.when(h, F.lit(c)) for h, c in zip((anchors, pages), SIGNALS, strict=True)]))


#: fixed values: the columns of a source manifest
MANIFEST = ("document_key", "document_id", "unique_source_id", "category", "filename", "extension", "source_path", "size_bytes", "sha256", "duplicate_occurrence_count", "duplicate_categories", "duplicate_document_keys", "preflight", "scenarios")


def source_manifest(records: DataFrame) -> DataFrame:
    """records (document_key, category, filename, extension, source_path, size_bytes, sha256, preflight, scenarios) with what
    shares their content: its id, how often it occurs, in which categories and under which keys."""
    g = records.groupBy("sha256").agg(F.count("*").alias("duplicate_occurrence_count"), F.array_sort(F.collect_set("category")).alias("duplicate_categories"), F.array_sort(F.collect_set("document_key")).alias("duplicate_document_keys"))
    j = records.join(g, "sha256").withColumns({"unique_source_id": F.substring("sha256", 1, 16), "document_id": F.substring(F.sha2("document_key", 256), 1, 16)})
    return j.select(*MANIFEST)
