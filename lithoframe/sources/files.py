"""Folders, saved documents, payloads and workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import file_extension, safe_path
from lithoframe.operators.model import Facts

#: fixed values: the suffixes of source files
SUFFIXES = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".md", ".txt", ".csv", ".html", ".htm", ".epub")
OLE_MAGIC = "D0CF11E0A1B11AE1"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def snapshot(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, sha256, size): files of the known suffixes below root, outside excluded folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape("/" + re.sub(r"^[a-z]+:/*", "", root).strip("/")) + "/", "")
    s = f.select(rel.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    for e in excluded:
        s = s.filter(~F.col("path").startswith(e.strip("/") + "/"))
    return s.filter(file_extension(F.col("path")).isin(*SUFFIXES) & safe_path(F.col("path")))


#: the nested record of a parsed document, as far as rules read it
PARSED = """document_id string, filename string, source_sha256 string, markdown string,
blocks array<struct<id:string,source_block_id:string,order_index:int,kind:string,text:string,heading_level:int,markdown:string,anchor:struct<page_number:int,bbox:array<double>,coordinate_system:string,bbox_granularity:string>,metadata:map<string,string>>>,
tables array<struct<table_id:string,block_id:string,html:string,markdown:string,caption:string,page_number:int,bbox:array<double>,num_rows:int,num_cols:int,header_rows:int,row_header_columns:array<int>,view_scope:string,source_row_count:int,emitted_row_count:int,hidden_row_count:int,parent_table_id:string,parent_cell_id:string,nesting_depth:int,metadata:map<string,string>,
cells:array<struct<cell_id:string,text:string,raw_value:string,value_type:string,start_row:int,start_col:int,row_span:int,col_span:int,column_header:boolean,row_header:boolean,bbox:array<double>>>,
grid:array<array<struct<kind:string,cell_id:string,origin_cell_id:string>>>>>,
assets array<struct<path:string,sha256:string>>, native_artifacts array<struct<artifact_id:string,sha256:string,required_for_quality:boolean>>,
capabilities map<string,struct<state:string,reason:string>>"""


def read_parsed(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(PARSED).option("multiLine", True).json(paths)


def facts_of(parsed: DataFrame) -> Facts:
    """The flat facts of nested documents."""
    key = F.coalesce("source_sha256", "document_id").alias("doc_id")
    b = parsed.select(key, F.posexplode("blocks").alias("position", "b")).select("doc_id", "position", F.col("b.id").alias("block_id"), "b.source_block_id", "b.order_index", "b.kind", "b.text", "b.heading_level", "b.markdown", "b.anchor.page_number", "b.anchor.bbox", "b.anchor.coordinate_system", "b.anchor.bbox_granularity", F.coalesce(F.element_at("b.metadata", "reference_label"), F.element_at("b.metadata", "marker")).alias("label"))
    t = parsed.select(key, F.explode("tables").alias("t")).select("doc_id", "t.*").withColumns({"structure_source": F.element_at("metadata", "structure_source"), "markdown_rendering": F.element_at("metadata", "markdown_rendering")})
    c = t.select("doc_id", "table_id", F.explode("cells").alias("c")).select("doc_id", "table_id", "c.*").withColumns({"row_span": F.coalesce("row_span", F.lit(1)), "col_span": F.coalesce("col_span", F.lit(1))})
    g = t.select("doc_id", "table_id", F.posexplode("grid").alias("r", "row")).select("doc_id", "table_id", "r", F.posexplode("row").alias("c", "s")).select("doc_id", "table_id", "r", "c", "s.kind", F.when(F.col("s.kind") == "origin", F.col("s.cell_id")).otherwise(F.col("s.origin_cell_id")).alias("cell_id"))
    caps = parsed.select(key, F.explode("capabilities").alias("name", "v")).select("doc_id", "name", "v.state", "v.reason")
    return Facts(parsed.select(key, F.coalesce("markdown", F.lit("")).alias("markdown")), b, t.drop("cells", "grid", "metadata"), c, g, parsed.select(key, F.inline("assets")), parsed.select(key, F.inline("native_artifacts")).withColumnRenamed("required_for_quality", "required"), caps)


def payload_blocks(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """Blocks of a loosely shaped JSON array: aliases in order, kinds inferred, wrong types dropped."""
    v = df.select(*keys, F.explode(F.from_json(json_col, "array<map<string,string>>")).alias("m"), F.lit(0).alias("_"))
    get = lambda *names: F.coalesce(*[F.nullif(F.element_at("m", n), F.lit("")) for n in names])
    kind = F.lower(F.coalesce(get("type", "kind", "label", "category"), F.lit("")))
    level = get("heading_level", "level", "text_level").try_cast("int")
    k = F.when(kind.rlike("table"), "table").when(kind.rlike("image|figure|picture"), "image").when(kind.rlike("formula|equation"), "formula").when(kind.rlike("title|heading|header") | (level > 0), "heading").when(kind.rlike("list"), "list").when(kind.rlike("code"), "code").otherwise("paragraph")
    return v.select(*keys, get("id", "block_id", "self_ref").alias("source_block_id"), k.alias("kind"), get("text", "content", "md", "markdown").alias("text"), F.when(k == "heading", level).alias("heading_level"), (get("page_number", "page", "page_no").try_cast("int").alias("page_number")))


def sidecar_files(files: DataFrame, preferred: tuple[str, ...] = ("full.md", "content.md", "output.md")) -> DataFrame:
    """(dir, artifact kind, path): of each folder's outputs, the preferred file of each kind."""
    name, d = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/[^/]*$", "")
    ext = file_extension(name)
    kind = F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".html", ".htm"), "html").when(ext == ".json", "json").when(ext.isin(".png", ".jpg", ".jpeg", ".webp", ".bmp"), "image").otherwise("other")
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.lower(name))
    f = files.select("path", d.alias("dir"), kind.alias("kind"), F.when(rank > 0, rank).otherwise(len(preferred) + 1).alias("rank"))
    w = Window.partitionBy("dir", "kind").orderBy("rank", "path")
    return f.withColumn("n", F.row_number().over(w)).filter("n = 1 or kind in ('image', 'other')").select("dir", "kind", "path")


def magic(content: Column) -> Column:
    """ole, zip, pdf or other, by the first bytes."""
    return F.when(F.hex(F.substring(content, 1, 8)) == OLE_MAGIC, "ole").when(F.hex(F.substring(content, 1, 2)) == "504B", "zip").when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf").otherwise("other")


def _sheet_rows(content: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            root = ElementTree.fromstring(z.read(sheet))
            filtered = root.find(f"{MAIN}autoFilter") is not None
            for row in root.iter(f"{MAIN}row"):
                for c in row.iter(f"{MAIN}c"):
                    v, f, kind = c.find(f"{MAIN}v"), c.find(f"{MAIN}f"), c.get("t", "n")
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    if value in (None, "") and f is None:
                        continue
                    out.append({"sheet": sheet[14:-4], "row": int(row.get("r", 0)), "cell_ref": c.get("r"), "value": value, "value_type": {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}.get(kind, "number"), "formula": f.text if f is not None else None, "hidden": row.get("hidden") in ("1", "true"), "has_filter": filtered})
    return out


def workbook_cells(files: DataFrame, content_col: str, *keys: str) -> DataFrame:
    """A row per filled cell of .xlsx contents: sheet, row, A1 reference, value, type, formula, hidden row, filter. Others give none."""
    fields = (("sheet", "string"), ("row", "int"), ("cell_ref", "string"), ("value", "string"), ("value_type", "string"), ("formula", "string"), ("hidden", "boolean"), ("has_filter", "boolean"))
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(contents: pa.Array) -> pa.Array:
        rows = []
        for c in contents.to_pylist():
            try:
                rows.append(_sheet_rows(c) if c else [])
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                rows.append([])
        return pa.array(rows, pa.list_(pa.struct([(n, kinds[k]) for n, k in fields])))

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "array<struct<" + ",".join(f"{n}:{k}" for n, k in fields) + ">>")
    return files.select(*keys, F.explode(udf(content_col)).alias("_c")).select(*keys, "_c.*")


def lines_of_words(words: DataFrame, gap: float = 3.0, *keys: str) -> DataFrame:
    """Words (keys, top, x0, text, size) grouped to lines where the vertical gap to the word before exceeds `gap`."""
    w = Window.partitionBy(*keys).orderBy("top", "x0")
    n = words.withColumn("_new", (F.col("top") - F.lag("top").over(w) > gap).cast("int")).withColumn("line", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    size = F.percentile("size", 0.5).over(Window.partitionBy(*keys))
    n = n.withColumn("_median", size)
    g = n.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("size").alias("size"), F.first("_median").alias("_median"))
    return g.select(*keys, "line", "text", F.when(F.col("size") > F.col("_median") * 1.2, "heading").otherwise("paragraph").alias("kind"))
