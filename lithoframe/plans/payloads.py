"""Queries on saved parser payloads, each with SQL. Orders are payloads: line items are table rows and OCR spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.session import materialized
from lithoframe.sources import payloads, preflight
from lithoframe.sources.lift import table


def numbered(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w) - 1)


def order_payloads(spark, sf_dir) -> DataFrame:
    """(doc_id, payload): a table and spans per order, with the aliases, holes and wrong types that saved outputs have."""
    k, r = F.col("l_orderkey"), F.col("r")
    li = numbered(spark, sf_dir)
    cell = F.struct(
        F.when(k % 4 == 0, r).alias("start_row"), F.when(k % 4 == 1, r).alias("row"), F.when(k % 4 == 2, r).alias("row_index"), F.when(k % 4 == 3, r).alias("start_row_offset_idx"), F.when((k % 5 != 4) | (r != 0), F.lit(0)).alias("col"), F.when(r % 3 == 0, r + 2).alias("end_row_offset_idx"), F.when(k % 6 == 0, 1).alias("row_span"),
        F.when(r % 2 == 0, F.concat(F.lit("c"), r.cast("string"))).alias("cell_id"), F.when(k % 3 == 0, F.col("l_returnflag")).alias("text"), F.when(k % 3 == 1, F.col("l_quantity").cast("long")).alias("value"), F.col("l_linenumber").cast("string").alias("raw_value"), (r == 0).alias("column_header"),
    )
    slot = F.struct(F.when(r % 2 == 0, "origin").otherwise("covered").alias("kind"), F.when(r % 2 == 0, F.concat(F.lit("c"), r.cast("string"))).alias("cell_id"), F.when(r % 2 == 1, F.concat(F.lit("c"), F.when(r % 4 == 1, r - 1).otherwise(r).cast("string"))).alias("origin_cell_id"))
    q = F.col("l_quantity")
    span = F.struct(F.when(r % 4 != 3, F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))).alias("text"), F.when(r % 5 != 4, F.array(q, F.lit(10.0), q + 5, F.lit(30.0))).alias("bbox"), F.when(k % 2 == 0, "BOTTOMLEFT").alias("coordinate_system"), F.when(r % 2 == 0, 0.5).alias("confidence"), F.lit(1).alias("page"))
    item = F.array_sort(F.collect_list(F.struct("r", cell.alias("cell"), slot.alias("slot"), span.alias("span"))))
    g = li.groupBy("l_orderkey").agg(item.alias("x"))
    get = lambda f: F.transform("x", lambda v: v[f])
    t = F.struct(F.when(k % 7 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("table_id"), F.when(k % 3 != 0, F.concat(F.lit("b"), k.cast("string"))).alias("source_block_id"), F.when(k % 2 == 0, F.size("x")).alias("num_rows"), F.when(k % 9 == 0, "odd").when(k % 9 == 1, "all_rows").alias("view_scope"), F.lit(1).alias("page_no"), F.array(F.lit(0), F.lit(-1)).alias("row_header_columns"), F.when(k % 10 != 0, get("cell")).alias("cells"), F.transform(get("slot"), lambda s: F.array(s)).alias("grid"), F.when(k % 10 == 0, F.struct(F.lit(3).alias("num_cols"), get("cell").alias("table_cells"))).alias("data"))
    p = F.struct(F.array(F.struct(F.lit(1).alias("page_number"), F.lit(100.0).alias("height"))).alias("pages"), F.array(t).alias("tables"), F.when(k % 11 != 0, get("span")).alias("ocr_spans"), F.when(k % 11 == 0, get("span")).alias("spans"))
    return g.select(k.cast("string").alias("doc_id"), F.to_json(p).alias("payload"))


def read(spark, sf_dir) -> DataFrame:
    return materialized(payloads.read_payloads(order_payloads(spark, sf_dir), "payload"))


def cells(spark, sf_dir) -> DataFrame:
    """SRC-15: cells of payload tables."""
    return payloads.payload_tables(read(spark, sf_dir), "doc_id")[1].select("doc_id", "table_id", "cell_id", "start_row", "start_col", "row_span", "col_span", "text", "raw_value", "column_header")


def tables(spark, sf_dir) -> DataFrame:
    """SRC-15: payload tables with defaults."""
    t = payloads.payload_tables(read(spark, sf_dir), "doc_id")[0]
    return t.select("doc_id", "table_id", "source_block_id", "page_number", "num_rows", "num_cols", "view_scope", F.size("row_header_columns").alias("row_headers"), "raw_cells")


def grid(spark, sf_dir) -> DataFrame:
    """SRC-15: grid slots that point to cells that are there."""
    return payloads.payload_tables(read(spark, sf_dir), "doc_id")[2].select("doc_id", "r", "kind", "cell_id")


def spans(spark, sf_dir) -> DataFrame:
    """SRC-16: OCR spans, boxes turned upright."""
    return payloads.ocr_spans(read(spark, sf_dir), "doc_id").select("doc_id", F.col("n").alias("r"), "level", "text", F.get("bbox", F.lit(0)).alias("left"), F.get("bbox", F.lit(1)).alias("top"), F.get("bbox", F.lit(3)).alias("bottom"), "confidence", "page_number")


def evidence(spark, sf_dir) -> tuple:
    p = read(spark, sf_dir)
    t, c, _ = payloads.payload_tables(p, "doc_id")
    k = F.col("doc_id").cast("long")
    docs = p.select("doc_id", (k % 5 != 0).alias("has_text"), (k % 4 == 0).alias("has_files"))
    blocks = p.filter(k % 3 != 0).select("doc_id", F.when(k % 2 == 0, 1).alias("page_number"), F.when(k % 8 == 1, F.array(F.lit(0.0))).alias("bbox"), F.when(k % 6 != 1, 0).alias("order_index"))
    return docs, blocks, t, c, payloads.ocr_spans(p, "doc_id")


def capabilities(spark, sf_dir) -> DataFrame:
    """PRJ-04: capabilities derived from evidence over defaults and declarations."""
    e = evidence(spark, sf_dir)
    k = F.col("doc_id").cast("long")
    native = e[0].filter(k % 7 == 0).select("doc_id", F.explode(F.array(F.lit("assets"), F.lit("page_bbox"))).alias("name"), F.lit("partial").alias("state"), F.lit("file").alias("granularity"))
    return payloads.observed_capabilities(*e, native)


def scores(spark, sf_dir) -> DataFrame:
    """PRJ-02: confidence by what was found."""
    return payloads.confidence(*evidence(spark, sf_dir))


def synthesised(spark, sf_dir) -> DataFrame:
    """SRC-15 and SORT-02: blocks for tables that no block has, all in order."""
    p = read(spark, sf_dir)
    t = payloads.payload_tables(p, "doc_id")[0]
    k = F.col("doc_id").cast("long")
    blocks = p.select("doc_id", F.explode(F.array(F.struct(F.lit("z").alias("source_block_id"), F.lit(None).cast("int").alias("order_index")), F.struct(F.concat(F.lit("b"), "doc_id").alias("source_block_id"), F.lit(0).alias("order_index")))).alias("b")).select("doc_id", "b.*").filter((k % 2 == 0) | (F.col("source_block_id") == "z")).withColumn("kind", F.lit("paragraph"))
    every = blocks.unionByName(payloads.table_blocks(t, blocks, "doc_id"), allowMissingColumns=True)
    return payloads.in_order(every, "doc_id").select("doc_id", "source_block_id", "kind", F.col("rn").cast("long").alias("rn"))


def nested(spark, sf_dir) -> DataFrame:
    """SRC-17: an order's table holds one for each customer's line, those one more."""
    li = numbered(spark, sf_dir)
    inner = F.when(F.col("r") % 2 == 0, F.array(F.struct(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.when(F.col("r") % 4 == 0, F.array(F.struct(F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"))).alias("cells")))).alias("tables"))).alias("cells"))))
    cell = F.struct(F.col("r").alias("row"), F.lit(0).alias("col"), inner.alias("tables"))
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.to_json(cell).alias("c")))), lambda v: v["c"]).alias("x"))
    j = g.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat(F.lit('{"tables":[{"cells":['), F.array_join("x", ","), F.lit("]}]}")).alias("payload"))
    return payloads.nested_tables(j, "payload", "doc_id")


def origins(spark, sf_dir) -> DataFrame:
    """SRC-22: a grid that repeats line items in the slots they cover, back to cells."""
    li = numbered(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("l_linenumber") % 3)))
    e = li.select(F.col("l_orderkey").alias("doc_id"), F.col("r").alias("start_row"), F.lit(0).alias("start_col"), F.col("r"), F.col("s").alias("c"), "l_partkey")
    return payloads.origin_cells(e, "doc_id").select("doc_id", "start_row", "l_partkey")


def content_lists(spark, sf_dir) -> DataFrame:
    """SRC-20 and SRC-21: two views of a content list, the later one wins for each source id."""
    li = numbered(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("source_block_id"), F.col("r").alias("n"), F.col("l_quantity").cast("long").alias("v"), "l_returnflag")
    return payloads.merged_items(li, li.filter("l_returnflag = 'R'").withColumn("v", -F.col("v"))).select("doc_id", "source_block_id", "n", "v")


def direct_texts(spark, sf_dir) -> DataFrame:
    """SRC-07: what passes as text without a parser."""
    d = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select("doc_id", F.concat(d.cast("string"), F.element_at(F.array(F.lit(".TXT"), F.lit(".pdf"), F.lit(".md")), (d % 3 + 1).cast("int"))).alias("filename"), F.when(d % 2 == 0, "text/plain").otherwise("application/x").alias("file_type"), F.when(d % 5 == 0, F.unhex(F.lit("ff41"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return payloads.placeholder(r).select("doc_id", F.sha2("markdown", 256).alias("markdown"), "warning")


def handed_over(spark, sf_dir) -> DataFrame:
    """SRC-06: results handed over in options."""
    k = F.col("p_partkey")
    o = F.map_filter(F.create_map(F.lit("markdown"), F.when(k % 2 == 0, F.col("p_name")), F.lit("html"), F.lit(""), F.lit("payload"), F.when(k % 3 == 0, F.lit('{"tables":[]}')).when(k % 3 == 1, F.lit("{broken")), F.lit("file:a"), F.when(k % 5 == 0, F.lit("x"))), lambda a, b: b.isNotNull())
    return payloads.supplied(table(spark, sf_dir, "part").select(k.alias("doc_id"), o.alias("options")))


LI = "li AS (SELECT *, l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS r FROM lineitem)"
T = "CASE WHEN k % 7 <> 0 THEN 't' || k WHEN k % 3 <> 0 THEN 'b' || k ELSE 'parser-table-0000' END"
B = "CASE WHEN k % 3 <> 0 THEN 'b' || k ELSE 'parser-table-0000' END"
CELLS = f"""{LI}, cells AS (SELECT k, k::VARCHAR AS doc_id, {T} AS table_id, r, CASE WHEN r % 2 = 0 THEN 'c' || r ELSE {T} || ':r' || r || 'c0' END AS cell_id, CASE WHEN k % 6 = 0 THEN 1 WHEN r % 3 = 0 THEN 2 ELSE 1 END AS row_span,
  CASE k % 3 WHEN 0 THEN l_returnflag WHEN 1 THEN l_quantity::BIGINT::VARCHAR ELSE l_linenumber::VARCHAR END AS text, l_linenumber::VARCHAR AS raw_value, r = 0 AS column_header FROM li WHERE NOT (k % 5 = 4 AND r = 0))"""
SPANS = f"{LI}, spans AS (SELECT k, k::VARCHAR AS doc_id, r, l_returnflag AS text, l_quantity AS l, CASE WHEN k % 2 = 0 THEN 70.0 ELSE 10.0 END AS top, CASE WHEN k % 2 = 0 THEN 90.0 ELSE 30.0 END AS bottom, CASE WHEN r % 2 = 0 THEN 0.5 END AS confidence FROM li WHERE r % 4 <> 3 AND r % 5 <> 4)"
#: a table lacks cells where its only line has no column
FACTS = f"""{LI}, o AS (SELECT k, k::VARCHAR AS doc_id, count(*) FILTER (NOT (k % 5 = 4 AND r = 0)) > 0 AS full_cells, count(*) FILTER (r % 4 <> 3 AND r % 5 <> 4) > 0 AS seen, k % 5 <> 0 AS has_text, k % 3 <> 0 AS has_blocks, k % 3 <> 0 AND (k % 2 = 0 OR k % 8 = 1) AS anchored FROM li GROUP BY k)"""

QUERIES = {
    "src_15_payload_cells": cells, "src_15_payload_tables": tables, "src_15_payload_grid": grid, "src_16_ocr_spans": spans, "prj_04_capabilities": capabilities, "prj_02_confidence": scores, "sort_02_table_blocks": synthesised, "src_17_nested_tables": nested, "src_22_origin_cells": origins, "src_20_content_lists": content_lists,
    "src_07_direct_text": direct_texts, "src_06_supplied": handed_over,
}
ORACLES = {
    "src_15_payload_cells": f"WITH {CELLS} SELECT doc_id, table_id, cell_id, r::INT AS start_row, 0 AS start_col, row_span, 1 AS col_span, text, raw_value, column_header FROM cells",
    "src_15_payload_tables": f"WITH {LI} SELECT k::VARCHAR AS doc_id, {T} AS table_id, {B} AS source_block_id, 1 AS page_number, CASE WHEN k % 2 = 0 THEN count(*) END::INT AS num_rows, CASE WHEN k % 10 = 0 THEN 3 END AS num_cols, CASE WHEN k % 9 = 1 THEN 'all_rows' ELSE 'unknown' END AS view_scope, 1 AS row_headers, count(*)::INT AS raw_cells FROM li GROUP BY k",
    "src_15_payload_grid": f"WITH {CELLS}, s AS (SELECT k, k::VARCHAR AS doc_id, r::INT AS r, CASE WHEN r % 2 = 0 THEN 'origin' ELSE 'covered' END AS kind, 'c' || CASE WHEN r % 4 = 1 THEN r - 1 ELSE r END AS cell_id FROM li) SELECT doc_id, r, kind, cell_id FROM s WHERE EXISTS (SELECT 1 FROM cells c WHERE c.k = s.k AND c.cell_id = s.cell_id)",
    "src_16_ocr_spans": f"WITH {SPANS} SELECT doc_id, r::INT AS r, 'span' AS level, text, l AS \"left\", top::DOUBLE AS top, bottom::DOUBLE AS bottom, confidence::DOUBLE AS confidence, 1 AS page_number FROM spans",
    "prj_02_confidence": f"WITH {FACTS} SELECT doc_id, has_text::INT::DOUBLE AS text, CASE WHEN has_blocks AND k % 8 = 1 THEN 0.7 ELSE 0 END::DOUBLE AS layout, CASE WHEN has_blocks AND k % 6 <> 1 THEN 0.8 ELSE 0 END::DOUBLE AS reading_order, CASE WHEN full_cells THEN 1 ELSE 0.4 END::DOUBLE AS table_score, 0.4::DOUBLE AS overall FROM o",
    "prj_04_capabilities": f"""WITH {FACTS}, n AS (SELECT o.*, k % 7 = 0 AS told FROM o) SELECT doc_id, 'text_content' AS name, CASE WHEN has_text THEN 'available' ELSE 'unavailable' END AS state, 'document' AS granularity FROM n
UNION ALL SELECT doc_id, 'page_bbox', CASE WHEN anchored THEN 'available' WHEN told THEN 'partial' ELSE 'unavailable' END, CASE WHEN NOT anchored AND told THEN 'file' ELSE 'block' END FROM n
UNION ALL SELECT doc_id, 'table_cells', CASE WHEN full_cells THEN 'available' ELSE 'partial' END, CASE WHEN full_cells THEN 'cell' ELSE 'table' END FROM n
UNION ALL SELECT doc_id, 'assets', CASE WHEN told THEN 'partial' ELSE 'unavailable' END, CASE WHEN told THEN 'file' END FROM n
UNION ALL SELECT doc_id, 'ocr_confidence', CASE WHEN seen THEN 'available' ELSE 'unavailable' END, 'span' FROM n UNION ALL SELECT doc_id, 'native_artifacts', CASE WHEN k % 4 = 0 THEN 'available' ELSE 'unavailable' END, NULL FROM n""",
    "sort_02_table_blocks": f"""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), x AS (SELECT k, 'z' AS source_block_id, 'paragraph' AS kind, 1000000000 AS o FROM o UNION ALL SELECT k, 'b' || k, 'paragraph', 0 FROM o WHERE k % 2 = 0
UNION ALL SELECT k, {B}, 'table', CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END FROM o WHERE k % 3 = 0 OR k % 2 <> 0) SELECT k::VARCHAR AS doc_id, source_block_id, kind, row_number() OVER (PARTITION BY k ORDER BY o, source_block_id) AS rn FROM x""",
    "src_17_nested_tables": f"WITH {LI}, n AS (SELECT k::VARCHAR AS doc_id, count(*) AS n FROM li GROUP BY k) SELECT doc_id, '0' AS path, '' AS parent_path, NULL AS parent_cell, 0 AS depth, n::INT AS n_cells FROM n UNION ALL SELECT k::VARCHAR, '0.0', '0', 'r' || r || 'c0', 1, 1 FROM li WHERE r % 2 = 0 UNION ALL SELECT k::VARCHAR, '0.0.0', '0.0', 'r0c0', 2, 1 FROM li WHERE r % 4 = 0",
    "src_22_origin_cells": f"WITH {LI} SELECT k AS doc_id, r::INT AS start_row, l_partkey FROM li",
    "src_20_content_lists": f"WITH {LI}, u AS (SELECT k AS doc_id, l_partkey AS source_block_id, r::INT AS n, l_quantity::BIGINT AS v, 0 AS view FROM li UNION ALL SELECT k, l_partkey, r::INT, -l_quantity::BIGINT, 1 FROM li WHERE l_returnflag = 'R') SELECT doc_id, source_block_id, n, v FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, source_block_id ORDER BY view DESC, n DESC) = 1",
    "src_07_direct_text": "SELECT doc_id, CASE WHEN ok THEN sha256(coalesce(text, '')) ELSE sha256('') END AS markdown, CASE WHEN NOT ok THEN 'no parser output and no plain text' END AS warning FROM (SELECT *, (doc_id % 3 <> 1 OR doc_id % 2 = 0) AND doc_id % 5 <> 0 AS ok FROM documents)",
    "src_06_supplied": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS markdown, NULL::VARCHAR AS html, CASE WHEN p_partkey % 3 = 0 THEN '{\"tables\":[]}' END AS payload, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS n_files, p_partkey % 2 = 0 OR p_partkey % 3 <> 2 OR p_partkey % 5 = 0 AS given FROM part",
}


# ---- files


def office_files(spark, sf_dir) -> DataFrame:
    """parts as PDF, DOCX, XLSX, legacy and damaged files."""
    import io
    import zipfile

    import pyarrow as pa

    def build(key: int, name: str) -> bytes:
        kind, n = key % 6, key % 4
        if kind == 0:
            return b"%PDF-1.4\n" + b"<< /Type /Page >>\n" * n + b"<< /Type /Pages >>\n" + b"<< /Subtype /Image >>\n" * (key % 3) + (b"(x) Tj" if key % 12 == 0 else b"")
        if kind == 3:
            return preflight.OLE + b"rest"
        if kind in (4, 5):
            return name.encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if kind == 1:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{preflight.W[1:-1]}"><w:t>{name}</w:t>' + "<w:tbl/>" * n + "</w:document>")
                z.writestr("word/media/a.png", b"x")
            else:
                z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{preflight.S[1:-1]}"><si><t>{name}</t></si></sst>')
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{preflight.S[1:-1]}"><c t="s"><v>0</v></c>' + "<c><v>7</v></c>" * n + "<c/></worksheet>")
                z.writestr("xl/tables/t1.xml", b"")
        return out.getvalue()

    def run(keys: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([build(k, n) for k, n in zip(keys.to_pylist(), names.to_pylist(), strict=True)], pa.binary())

    run.__annotations__ = {"keys": pa.Array, "names": pa.Array, "return": pa.Array}
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".docx", ".XLSX", ".doc", ".docx", ".txt")]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k, F.concat("p_name", ext).alias("filename"), F.arrow_udf(run, "binary")(k, F.col("p_name")).alias("content"))


def file_facts(spark, sf_dir) -> DataFrame:
    """SRC-29: what files say of themselves."""
    p = preflight.preflight(office_files(spark, sf_dir))
    return p.select("p_partkey", "source_kind", "page_count", "sheet_count", "has_text_layer", "source_text_chars", "source_table_count", "source_cell_count", "source_media_count", "source_image_object_count", "is_corrupt", F.col("warning").isNotNull().alias("warned"))


QUERIES["src_29_preflight"] = file_facts
ORACLES["src_29_preflight"] = """WITH p AS (SELECT p_partkey, p_partkey % 6 AS kind, p_partkey % 4 AS n, length(p_name) AS l FROM part)
SELECT p_partkey, ['pdf', 'docx', 'xlsx', 'doc', 'docx', 'txt'][kind + 1] AS source_kind, CASE WHEN kind = 0 THEN n END::INT AS page_count, CASE WHEN kind = 2 THEN 1 END AS sheet_count, CASE WHEN kind = 0 THEN p_partkey % 12 = 0 WHEN kind IN (1, 2) THEN true END AS has_text_layer,
  CASE kind WHEN 1 THEN l WHEN 2 THEN l + 2 * n END AS source_text_chars, CASE kind WHEN 1 THEN n WHEN 2 THEN 1 END::INT AS source_table_count, CASE WHEN kind = 2 THEN n + 1 END::INT AS source_cell_count, CASE kind WHEN 1 THEN 1 WHEN 2 THEN 0 END AS source_media_count,
  CASE WHEN kind = 0 THEN p_partkey % 3 END::INT AS source_image_object_count, kind = 4 AS is_corrupt, kind IN (3, 4, 5) AS warned FROM p"""
