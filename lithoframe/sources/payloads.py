"""Saved parser payloads (JSON) to flat facts: tables, cells, grids, OCR spans, nested tables, capabilities.

Payloads are loosely shaped: a field of another type than expected counts as absent, the first usable alias wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import coordinate_system, stable_key, uuid5
from lithoframe.operators.content import text
from lithoframe.operators.model import Facts
from lithoframe.sources import markdown as md

CELL = """struct<start_row:int,row:int,row_index:int,start_row_offset_idx:int,start_col:int,col:int,col_index:int,start_col_offset_idx:int,end_row_offset_idx:int,end_col_offset_idx:int,row_span:int,col_span:int,
cell_id:string,text:string,value:string,raw_value:string,display_value:string,value_type:string,column_header:boolean,row_header:boolean,bbox:array<double>,coordinate_system:string,tables:array<string>>"""
TABLE = f"""struct<table_id:string,id:string,source_block_id:string,block_id:string,html:string,markdown:string,text:string,caption:string,page_number:int,page:int,page_no:int,bbox:array<double>,coordinate_system:string,num_rows:int,num_cols:int,header_rows:int,
row_header_columns:array<int>,view_scope:string,source_row_count:int,emitted_row_count:int,hidden_row_count:int,parent_table_id:string,parent_cell_id:string,nesting_depth:int,cells:array<{CELL}>,data:struct<num_rows:int,num_cols:int,table_cells:array<{CELL}>>,
grid:array<array<struct<kind:string,cell_id:string,origin_cell_id:string>>>>"""
SPAN = "struct<level:string,text:string,content:string,bbox:array<double>,coordinate_system:string,confidence:double,page_number:int,page:int,page_no:int,rotation_angle:double>"
PAGE = "struct<page_number:int,page_no:int,width:double,height:double>"
PAYLOAD = f"struct<pages:array<{PAGE}>,tables:array<{TABLE}>,ocr_spans:array<{SPAN}>,spans:array<{SPAN}>,ocr:array<{SPAN}>>"
SCOPES = ("all_rows", "visible_rows", "unknown")  # fixed values: what a table shows of its source
NONE = "unavailable"


def upright(box: Column, system: Column, height: Column) -> Column:
    """A box of four numbers with its origin at the top left, as far as the page's height is known."""
    v = [F.get(box, F.lit(i)) for i in range(4)]
    up = F.coalesce(coordinate_system(system) == "bottom_left_absolute", F.lit(False)) & height.isNotNull()
    ys = F.array(F.least(height - v[1], height - v[3]), F.greatest(height - v[1], height - v[3]))
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()), F.when(up, F.array(v[0], F.get(ys, F.lit(0)), v[2], F.get(ys, F.lit(1)))).otherwise(box))


def height_of(pages: Column, number: Column) -> Column:
    own = F.filter(pages, lambda p: F.coalesce(p["page_number"], p["page_no"]) == number)
    return F.get(own, F.lit(0))["height"]


def read_payloads(df: DataFrame, json_col: str) -> DataFrame:
    """df with _p: the payload's known fields, parsed once."""
    return df.withColumn("_p", F.from_json(json_col, PAYLOAD))


def payload_tables(parsed: DataFrame, *keys: str, parser: str = "parser") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, grid) of read payloads. Cells without an integer place and grid slots of unknown cells go."""
    t = parsed.select(*keys, F.col("_p.pages").alias("_pages"), F.posexplode("_p.tables").alias("n", "t")).filter("t is not null")
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"t.{x}"), F.lit("")) for x in names])
    source = F.coalesce(first("source_block_id", "block_id", "id"), F.concat(F.lit(f"{parser}-table-"), F.lpad(F.col("n").cast("string"), 4, "0")))
    page = F.coalesce("t.page_number", "t.page", "t.page_no")
    scope = F.when(F.col("t.view_scope").isin(*SCOPES), F.col("t.view_scope")).otherwise("unknown")
    raw = F.coalesce("t.cells", "t.data.table_cells")
    t = t.withColumns({"table_id": F.coalesce(first("table_id", "id"), source), "source_block_id": source, "page_number": page, "_cells": raw})
    height = height_of(F.col("_pages"), F.col("page_number"))
    tables = t.select(
        *keys, "table_id", "source_block_id", "page_number", F.coalesce("t.num_rows", "t.data.num_rows").alias("num_rows"), F.coalesce("t.num_cols", "t.data.num_cols").alias("num_cols"), F.col("t.header_rows"), F.filter("t.row_header_columns", lambda c: c >= 0).alias("row_header_columns"),
        upright(F.col("t.bbox"), F.col("t.coordinate_system"), height).alias("bbox"), "t.caption", "t.html", "t.markdown", scope.alias("view_scope"), "t.source_row_count", "t.emitted_row_count", "t.hidden_row_count", "t.parent_table_id", "t.parent_cell_id", F.coalesce("t.nesting_depth", F.lit(0)).alias("nesting_depth"), F.coalesce(F.size("_cells"), F.lit(0)).alias("raw_cells"),
    )
    c = t.select(*keys, "table_id", F.col("t.coordinate_system").alias("_sys"), height.alias("_height"), F.explode("_cells").alias("c"))
    row, col = F.coalesce(*[F.col(f"c.{x}") for x in ("start_row", "row", "row_index", "start_row_offset_idx")]), F.coalesce(*[F.col(f"c.{x}") for x in ("start_col", "col", "col_index", "start_col_offset_idx")])
    c = c.withColumns({"start_row": row, "start_col": col}).filter("start_row is not null and start_col is not null")
    span = lambda own, end, start: F.coalesce(F.col(f"c.{own}"), F.greatest(F.lit(1), F.col(f"c.{end}") - F.col(start)), F.lit(1))
    cells = c.select(
        *keys, "table_id", F.coalesce(F.nullif(F.col("c.cell_id"), F.lit("")), text(F.col("table_id"), ":r", F.col("start_row"), "c", F.col("start_col"))).alias("cell_id"), "start_row", "start_col", span("row_span", "end_row_offset_idx", "start_row").alias("row_span"), span("col_span", "end_col_offset_idx", "start_col").alias("col_span"),
        F.coalesce("c.display_value", "c.text", "c.value", "c.raw_value", F.lit("")).alias("text"), "c.raw_value", "c.value_type", F.coalesce("c.column_header", F.lit(False)).alias("column_header"), F.coalesce("c.row_header", F.lit(False)).alias("row_header"), upright(F.col("c.bbox"), F.coalesce("c.coordinate_system", "_sys"), F.col("_height")).alias("bbox"),
    )
    g = t.select(*keys, "table_id", F.posexplode("t.grid").alias("r", "row")).select(*keys, "table_id", "r", F.posexplode("row").alias("c", "s"))
    g = g.select(*keys, "table_id", "r", "c", "s.kind", F.when(F.col("s.kind") == "origin", F.col("s.cell_id")).when(F.col("s.kind") == "covered", F.col("s.origin_cell_id")).alias("cell_id"))
    known = cells.select(*keys, "table_id", "cell_id").distinct()
    return tables, cells, g.join(known, [*keys, "table_id", "cell_id"], "left_semi")


def table_blocks(tables: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks for tables whose source_block_id no block has: after all others, in the order of their tables' ids."""
    last = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    new = tables.groupBy(*keys, "source_block_id").agg(F.min("table_id").alias("table_id"), F.min_by("markdown", "table_id").alias("markdown"), F.min_by("page_number", "table_id").alias("page_number"))
    new = new.join(blocks.select(*keys, "source_block_id").distinct(), [*keys, "source_block_id"], "left_anti").join(last, list(keys), "left")
    at = F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy("table_id")) - 1
    return new.select(*keys, "source_block_id", at.cast("int").alias("order_index"), F.lit("table").alias("kind"), "markdown", "page_number")


def in_order(blocks: DataFrame, *keys: str) -> DataFrame:
    """blocks with rn: by order_index, none last, ties by source id (SORT-02)."""
    return blocks.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("order_index", F.lit(10**9)), "source_block_id")))


def ocr_spans(parsed: DataFrame, *keys: str) -> DataFrame:
    """OCR spans that have a box and a text."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    s = parsed.select(*keys, F.col("_p.pages").alias("_pages"), F.posexplode(F.coalesce(filled("_p.ocr_spans"), filled("_p.spans"), filled("_p.ocr"))).alias("n", "s")).filter("s is not null")
    page = F.coalesce("s.page_number", "s.page", "s.page_no")
    s = s.select(*keys, "n", F.coalesce(F.nullif(F.col("s.level"), F.lit("")), F.lit("span")).alias("level"), F.trim(F.coalesce("s.text", "s.content", F.lit(""))).alias("text"), upright(F.col("s.bbox"), F.col("s.coordinate_system"), height_of(F.col("_pages"), page)).alias("bbox"), "s.confidence", page.alias("page_number"), "s.rotation_angle")
    return s.filter("bbox is not null and text <> ''")


def nested_tables(df: DataFrame, json_col: str, *keys: str, deepest: int = 16) -> DataFrame:
    """(keys, path, parent_path, parent_cell, depth, n_cells): tables within cells, level by level, to `deepest` levels.

    Each level is one pass over what the level above still holds; documents without deeper tables leave early.
    """
    cells = f"array<struct<cells:array<{CELL}>>>"
    level = df.select(*keys, F.posexplode(F.from_json(F.get_json_object(json_col, "$.tables"), cells)).alias("i", "t"), F.lit("").alias("parent_path"), F.lit(None).cast("string").alias("parent_cell"))
    out = None
    for depth in range(deepest):
        level = level.withColumn("path", F.concat_ws(".", F.nullif("parent_path", F.lit("")), F.col("i").cast("string")))
        rows = level.select(*keys, "path", "parent_path", "parent_cell", F.lit(depth).alias("depth"), F.coalesce(F.size("t.cells"), F.lit(0)).alias("n_cells"))
        out = rows if out is None else out.unionByName(rows)
        inner = level.select(*keys, F.col("path").alias("parent_path"), F.explode("t.cells").alias("c")).filter("size(c.tables) > 0")
        if inner.isEmpty():
            break
        level = inner.select(*keys, "parent_path", F.coalesce("c.cell_id", text("r", F.coalesce("c.start_row", "c.row"), "c", F.coalesce("c.start_col", "c.col"))).alias("parent_cell"), F.posexplode("c.tables").alias("i", "_json"))
        level = level.withColumn("t", F.from_json("_json", f"struct<cells:array<{CELL}>>"))
    return out


def origin_cells(expanded: DataFrame, *keys: str) -> DataFrame:
    """Of a grid that repeats a cell in every slot it covers (r, c, start_row, start_col, ...): each cell once, at its origin."""
    return expanded.filter("r = start_row and c = start_col").dropDuplicates([*keys, "start_row", "start_col"])


def merged_items(*views: DataFrame, key: str = "source_block_id", order: str = "n") -> DataFrame:
    """Several views of one content list: for each source id the item of the last view, then of the greatest place."""
    u = None
    for i, v in enumerate(views):
        v = v.withColumn("_view", F.lit(i))
        u = v if u is None else u.unionByName(v, allowMissingColumns=True)
    w = Window.partitionBy("doc_id", key).orderBy(F.desc("_view"), F.desc(order))
    return u.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_view")


def observed_capabilities(docs: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, spans: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, state, granularity): defaults, then what the native result declares, then what the evidence shows.

    docs: doc_id, has_text, has_files. native: doc_id, name, state, granularity.
    """
    per_doc = lambda df, *agg: df.groupBy("doc_id").agg(*agg)
    per_table = tables.select("doc_id", "table_id").distinct().join(cells.groupBy("doc_id", "table_id").agg(F.lit(1).alias("c")), ["doc_id", "table_id"], "left")
    j = docs.join(per_doc(blocks, F.bool_or(F.col("page_number").isNotNull() | F.col("bbox").isNotNull()).alias("anchored")), "doc_id", "left")
    j = j.join(per_doc(per_table, F.bool_and(F.col("c").isNotNull()).alias("all_cells")), "doc_id", "left").join(per_doc(spans, F.count("*").alias("n_spans")), "doc_id", "left")
    fact = lambda name, state, granularity: F.struct(F.lit(name).alias("name"), state.alias("state"), (F.lit(granularity) if isinstance(granularity, str) else granularity).alias("granularity"))
    yes, no, null = F.lit("available"), F.lit(NONE), F.lit(None).cast("string")
    facts = [
        fact("text_content", F.when(F.col("has_text"), yes).otherwise(no), "document"), fact("page_bbox", F.when(F.col("anchored"), yes).otherwise(no), "block"),
        fact("table_cells", F.when(F.col("all_cells"), yes).when(F.col("all_cells").isNotNull(), "partial").otherwise(no), F.when(F.col("all_cells"), "cell").otherwise("table")), fact("assets", no, null),
        fact("ocr_confidence", F.when(F.col("n_spans") > 0, yes).otherwise(no), "span"), fact("native_artifacts", F.when(F.col("has_files"), yes).otherwise(no), null),
    ]
    found = j.select("doc_id", F.inline(F.array(*facts)))
    if native is None:
        return found
    n = native.select("doc_id", "name", F.col("state").alias("_s"), F.col("granularity").alias("_g"))
    both = found.join(n, ["doc_id", "name"], "full_outer")
    # evidence that was seen overrides what is declared, a default doesn't
    own = F.coalesce(F.col("state") != NONE, F.lit(False)) & (F.col("name") != "text_content")
    return both.select("doc_id", "name", F.when(own | F.col("_s").isNull(), F.col("state")).otherwise(F.col("_s")).alias("state"), F.when(own | F.col("_s").isNull(), F.col("granularity")).otherwise(F.col("_g")).alias("granularity"))


def confidence(docs: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, layout, reading_order, table_score, overall) by what was found."""
    per_table = tables.select("doc_id", "table_id").distinct().join(cells.groupBy("doc_id", "table_id").agg(F.lit(1).alias("c")), ["doc_id", "table_id"], "left").groupBy("doc_id").agg(F.bool_and(F.col("c").isNotNull()).alias("full"))
    b = blocks.groupBy("doc_id").agg(F.bool_or(F.col("bbox").isNotNull()).alias("boxed"), F.bool_or(F.col("order_index").isNotNull()).alias("ordered"))
    j = docs.join(b, "doc_id", "left").join(per_table, "doc_id", "left").join(spans.select("doc_id").distinct().withColumn("seen", F.lit(True)), "doc_id", "left")
    some = F.col("boxed").isNotNull() | F.col("full").isNotNull() | F.col("seen").isNotNull()
    return j.select("doc_id", F.when(F.col("has_text"), 1.0).otherwise(0.0).alias("text"), F.when(F.col("boxed"), 0.7).otherwise(0.0).alias("layout"), F.when(F.col("ordered"), 0.8).otherwise(0.0).alias("reading_order"), F.when(F.col("full"), 1.0).when(F.col("full").isNotNull(), 0.4).otherwise(0.0).alias("table_score"), F.when(some, 0.4).when(F.col("has_text"), 0.2).otherwise(0.0).alias("overall"))


def normalised(native: DataFrame, payload_blocks) -> Facts:
    """Native results (doc_id, markdown, payload) as facts: blocks of the payload, else of the Markdown, and table blocks.

    payload_blocks: reads (doc_id, payload) to blocks. Blocks are in order, those without one last.
    """
    p = read_payloads(native.select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"), "payload"), "payload")
    own = payload_blocks(native.select("doc_id", "payload"))
    from_md = md.blocks(p.join(own.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "markdown")).withColumn("source_block_id", text("md-", F.col("order_index")))
    blocks = own.unionByName(from_md, allowMissingColumns=True)
    tables, cells, grid = payload_tables(p, "doc_id")
    blocks = blocks.unionByName(table_blocks(tables, blocks, "doc_id"), allowMissingColumns=True)
    blocks = in_order(blocks, "doc_id").withColumns({"block_id": F.coalesce("source_block_id", F.col("rn").cast("string")), "position": F.col("rn")})
    tables = tables.withColumn("block_id", F.col("source_block_id"))
    return Facts(p.select("doc_id", "markdown"), blocks, tables, cells, grid)


def placeholder(requests: DataFrame) -> DataFrame:
    """(doc_id, markdown, warning) of requests (doc_id, filename, file_type, content): text formats in UTF-8 pass, else nothing is made up."""
    texty = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)).isin(".txt", ".md", ".markdown", ".csv", ".json", ".html", ".xml") | F.lower("file_type").startswith("text/")
    ok = texty & F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    return requests.select("doc_id", F.when(ok, F.decode("content", "UTF-8")).otherwise("").alias("markdown"), F.when(~ok, "no parser output and no plain text").alias("warning"))


def supplied(requests: DataFrame) -> DataFrame:
    """(doc_id, markdown, html, payload, n_files, given) of results handed over in options (a map of strings)."""
    o = F.col("options")
    get = lambda k: F.nullif(F.element_at(o, k), F.lit(""))
    files = F.size(F.filter(F.map_keys(o), lambda k: k.startswith("file:")))
    return requests.select("doc_id", get("markdown").alias("markdown"), get("html").alias("html"), F.when(F.try_parse_json(get("payload")).isNotNull(), get("payload")).alias("payload"), files.alias("n_files"), (get("markdown").isNotNull() | get("html").isNotNull() | get("payload").isNotNull() | (files > 0)).alias("given"))


def identified_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown (doc_id, markdown) with ids that depend on the document and their place alone."""
    b = md.blocks(docs).withColumn("source_block_id", text("md-", F.col("order_index")))
    return b.withColumn("block_id", uuid5(stable_key(F.lit("block"), F.col("doc_id"), F.col("source_block_id"), F.col("order_index"))))
