"""What a source file says of itself before any parser runs: pages, sheets, tables, cells, media, text."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.exprs import file_extension

FIELDS = {"source_kind": pa.string(), "page_count": pa.int32(), "sheet_count": pa.int32(), "has_text_layer": pa.bool_(), "source_text_chars": pa.int64(), "source_table_count": pa.int32(), "source_cell_count": pa.int32(), "source_media_count": pa.int32(), "source_image_object_count": pa.int32(), "is_corrupt": pa.bool_(), "is_encrypted": pa.bool_(), "warning": pa.string()}
DDL = "struct<source_kind:string,page_count:int,sheet_count:int,has_text_layer:boolean,source_text_chars:bigint,source_table_count:int,source_cell_count:int,source_media_count:int,source_image_object_count:int,is_corrupt:boolean,is_encrypted:boolean,warning:string>"
MOST = 1 << 28  # bytes of one part of an archive or one stream
# fixed values: the legacy container's first bytes, and the name spaces of office documents
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
W, S, EP = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/extended-properties}"
LEGACY = (".doc", ".ppt", ".xls")


def part(archive: zipfile.ZipFile, name: str) -> bytes:
    with archive.open(name) as f:
        raw = f.read(MOST + 1)
    if len(raw) > MOST:
        raise ValueError(f"{name} is too large")
    return raw


def pdf(raw: bytes) -> dict:
    """Objects are counted in the file and in its deflated streams; a page without text operators has no text layer.

    Texts aren't decoded (that takes each font's tables), so there is no number of characters.
    """
    if raw[:1024].find(b"%PDF-") < 0:
        raise ValueError("no PDF header")
    bodies = [raw]
    for m in re.finditer(rb"stream\r?\n", raw):
        end = raw.find(b"endstream", m.end())
        try:
            bodies.append(zlib.decompressobj().decompress(raw[m.end() : end if end >= 0 else len(raw)], MOST))
        except zlib.error:
            continue
    count = lambda pattern: sum(len(re.findall(pattern, b)) for b in bodies)
    return {"page_count": count(rb"/Type\s*/Page(?![A-Za-z])"), "source_image_object_count": count(rb"/Subtype\s*/Image(?![A-Za-z])"), "has_text_layer": count(rb"(?<![A-Za-z])(?:Tj|TJ)(?![A-Za-z])") > 0, "is_encrypted": b"/Encrypt" in raw}


def media(names: list[str], folder: str) -> int:
    return sum(n.startswith(folder) and not n.endswith("/") for n in names)


def docx(raw: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(raw)) as a:
        names, root = a.namelist(), ElementTree.fromstring(part(a, "word/document.xml"))
        pages = ElementTree.fromstring(part(a, "docProps/app.xml")).findtext(f"{EP}Pages") if "docProps/app.xml" in names else None
    text = "\n".join(x.text or "" for x in root.iter(f"{W}t"))
    return {"page_count": int(pages) if pages and pages.isdigit() else None, "has_text_layer": True, "source_text_chars": len(text), "source_table_count": sum(1 for _ in root.iter(f"{W}tbl")), "source_media_count": media(names, "word/media/")}


def xlsx(raw: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(raw)) as a:
        names = a.namelist()
        shared = ["".join(t.text or "" for t in x.iter(f"{S}t")) for x in ElementTree.fromstring(part(a, "xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in names else []
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        values = []
        for n in sheets:
            for c in ElementTree.fromstring(part(a, n)).iter(f"{S}c"):
                v, own = c.findtext(f"{S}v"), "".join(t.text or "" for t in c.iter(f"{S}t"))
                if v is not None or own:
                    values.append(shared[int(v)] if c.get("t") == "s" else own or v)
    return {"sheet_count": len(sheets), "has_text_layer": True, "source_cell_count": len(values), "source_text_chars": len("\n".join(values)), "source_table_count": sum(n.startswith("xl/tables/") and n.endswith(".xml") for n in names), "source_media_count": media(names, "xl/media/")}


def legacy(raw: bytes) -> dict:
    if raw[:8] != OLE:
        raise ValueError("no OLE header")
    return {"warning": "a legacy container shows its header only"}


READERS = {".pdf": pdf, ".docx": docx, ".xlsx": xlsx} | dict.fromkeys(LEGACY, legacy)


def examine(ext: str | None, raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    out = dict.fromkeys(FIELDS) | {"source_kind": (ext or "").lstrip("."), "is_corrupt": False, "is_encrypted": False}
    if ext not in READERS:
        return out | {"warning": "no scan for this format"}
    try:
        return out | READERS[ext](raw)
    except Exception as e:  # whatever a damaged file makes the readers raise is its finding
        return out | {"is_corrupt": True, "warning": f"{type(e).__name__}"}


def preflight(df: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """df without its content, with what each file says of itself. The suffix decides the scan; null contents give nulls."""

    def run(exts: pa.Array, raws: pa.Array) -> pa.Array:
        return pa.array([examine(e, r) for e, r in zip(exts.to_pylist(), raws.to_pylist(), strict=True)], pa.struct(list(FIELDS.items())))

    run.__annotations__ = {"exts": pa.Array, "raws": pa.Array, "return": pa.Array}
    rest = [c for c in df.columns if c != content]
    return df.withColumn("_p", F.arrow_udf(run, DDL)(F.lower(file_extension(F.col(name))), F.col(content))).select(*rest, "_p.*")


def read_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines of a schema; none where the path isn't there, and lines that aren't JSON are passed over."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)
