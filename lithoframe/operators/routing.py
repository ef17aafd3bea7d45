"""Parser routing: decision list, availability, manual and repeated choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.exprs import file_extension

#: fixed values: extension classes and the order of candidates of each
TEXT = (".md", ".markdown", ".txt")
CSV = (".csv",)
EXCEL = (".xls", ".xlsx")
LEGACY = (".doc", ".ppt", ".xls")
OFFICE = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
WEB = (".html", ".htm", ".adoc", ".asciidoc", ".eml", ".epub")
IMAGE = (".bmp", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
READABLE = (".md", ".markdown", ".txt", ".csv")
SECRET_OPTIONS = ("api_token", "token", "api_key", "password", "authorization")
PARSERS = (
    ("markitdown", TEXT + CSV + EXCEL + OFFICE + (".html", ".htm", ".epub", ".pdf"), False, True, None),
    ("anydoc", OFFICE + CSV, False, True, None),
    ("docling", (".docx", ".pptx", ".xlsx", ".pdf", ".csv") + WEB + IMAGE, False, True, None),
    ("mineru", (".pdf",) + IMAGE, True, True, None),
    ("ocr", (".pdf",) + IMAGE, False, False, "no OCR engine"),
)


def registry(spark: SparkSession, rows=PARSERS) -> DataFrame:
    """The parsers as a dimension; ids are unique."""
    ids = [r[0] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError("parser ids must be unique")
    return spark.createDataFrame([(r[0], list(r[1]), *r[2:]) for r in rows], "parser_id string, formats array<string>, requires_network boolean, available boolean, reason string")


def signals(files: DataFrame, name: str = "filename", size: str = "size") -> DataFrame:
    """files with ext, and has_text for the suffixes that are text by themselves."""
    ext = file_extension(F.col(name))
    return files.withColumns({"ext": ext, "size_bytes": F.col(size).cast("long"), "has_text": F.when(ext.isin(*READABLE), F.lit(True))})


def plan(ext: Column, quality_first: Column, libreoffice: Column) -> Column:
    """Candidate parsers of an extension, first choice first."""
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    return (
        F.when(ext.isin(*TEXT), a("markitdown"))
        .when(ext.isin(*CSV), a("markitdown", "docling", "anydoc"))
        .when(ext.isin(*EXCEL), a("anydoc", "markitdown"))
        .when(ext.isin(*LEGACY), F.when(libreoffice, a("markitdown", "anydoc", "docling")).otherwise(a("anydoc", "markitdown")))
        .when(ext.isin(*OFFICE), a("docling", "anydoc", "markitdown"))
        .when(ext.isin(*WEB), a("docling", "markitdown"))
        .when(ext == ".pdf", a("mineru", "docling", "ocr", "markitdown"))
        .when(ext.isin(*IMAGE), F.when(quality_first, a("mineru", "docling", "ocr")).otherwise(a("docling", "ocr", "mineru")))
        .otherwise(a("markitdown"))
    )


def supports(formats: Column, ext: Column, parser: Column) -> Column:
    return F.array_contains(formats, ext) | ((parser == "markitdown") & ext.isin(*LEGACY))


def automatic(requests: DataFrame, parsers: DataFrame) -> DataFrame:
    """requests (request_id, ext, quality_first, libreoffice, allow_cloud) with selected, fallbacks, reasons, error.

    parsers is a dimension of a few rows; candidates are exploded with their place and the first usable wins.
    """
    c = requests.withColumn("plan", plan(F.col("ext"), F.col("quality_first"), F.col("libreoffice"))).select("request_id", "ext", "allow_cloud", "plan", F.posexplode("plan").alias("ord", "parser_id"))
    j = c.join(F.broadcast(parsers), "parser_id", "left")  # a dimension: one row per parser
    why = F.when(F.col("requires_network") & ~F.col("allow_cloud"), "cloud forbidden").when(~supports(F.col("formats"), F.col("ext"), F.col("parser_id")), "format not supported").when(~F.col("available"), F.coalesce("reason", F.lit("unavailable")))
    j = j.withColumn("why", F.when(F.col("available").isNull(), "unknown parser").otherwise(why))
    j = j.select("request_id", "ext", "plan", "ord", "parser_id", "why")
    usable = F.array_sort(F.collect_list(F.when(F.col("why").isNull(), F.struct("ord", "parser_id"))))
    no = F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("ord", "parser_id", "why"))))
    g = j.groupBy("request_id", "ext", "plan").agg(usable.alias("u"), no.alias("no"))
    names = F.col("u.parser_id")
    return g.select("request_id", "ext", F.get(names, F.lit(0)).alias("selected"), F.slice(names, 2, 100).alias("fallbacks"), F.transform("no", lambda x: F.concat_ws(": ", x["parser_id"], x["why"])).alias("unavailable"), (F.size("u") > 1).alias("may_fall_back"), (F.get(names, F.lit(0)) != F.get("plan", F.lit(0))).alias("second_choice"), F.when(F.size("u") == 0, "no executable parser").alias("error"))


def manual(requests: DataFrame, parsers: DataFrame) -> DataFrame:
    """requests (request_id, ext, parser_id, allow_cloud): the guards in order, cloud, format, availability."""
    j = requests.join(F.broadcast(parsers), "parser_id", "left")  # a dimension: one row per parser
    error = F.when(F.col("available").isNull(), "unknown parser").when(F.col("requires_network") & ~F.col("allow_cloud"), "cloud forbidden").when(~supports(F.col("formats"), F.col("ext"), F.col("parser_id")), "format not supported").when(~F.col("available"), F.coalesce("reason", F.lit("unavailable")))
    return j.select("request_id", "ext", "parser_id", error.alias("error"), F.when(error.isNull(), F.col("parser_id")).alias("selected"))


def reparse(requests: DataFrame, parsers: DataFrame) -> DataFrame:
    """requests (request_id, ext, parser_id, allow_cloud, attempted, options, more): repeats are refused, options merged."""
    m = manual(requests, parsers).select("request_id", "error", "selected")
    repeat = F.array_contains("attempted", F.col("parser_id"))
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter("options", lambda k, v: ~F.array_contains(F.map_keys("more"), k) & (k != "reparse"))), F.map_entries(F.map_filter("more", lambda k, v: k != "reparse")), F.array(F.struct(F.lit("reparse").alias("key"), F.lit("true").alias("value")))))
    j = requests.join(m, "request_id")
    err = F.when(repeat, "already attempted").otherwise(F.col("error"))
    return j.select("request_id", err.alias("error"), F.when(err.isNull(), F.col("selected")).alias("selected"), F.lit("auto").alias("mode"), F.lit(False).alias("may_fall_back"), F.when(err.isNull(), merged).alias("options"))


def without_secrets(options: Column) -> Column:
    return F.map_filter(options, lambda k, v: ~k.isin(*SECRET_OPTIONS))


def parser_options(selected: Column, ext: Column, scanned: Column, language: Column) -> Column:
    """Options of the chosen parser as a map."""
    ocr = (ext.isin(*IMAGE) | (F.coalesce(scanned, F.lit(0.0)) >= 0.5)).cast("string")
    lang = F.when(F.lower(language).startswith("zh"), "ch").when(F.lower(language).startswith("en"), "en").otherwise("auto")
    e = F.create_map().cast("map<string,string>")
    return F.when(selected == "mineru", F.create_map(F.lit("is_ocr"), ocr, F.lit("language"), lang)).when(selected == "docling", F.create_map(F.lit("do_ocr"), ocr)).when(selected == "ocr", F.create_map(F.lit("language"), lang)).otherwise(e)


def attempt(candidates: DataFrame) -> DataFrame:
    """(request_id, ord, parser_id, failed, empty) of saved outputs: the first that neither failed nor is empty, and the tries before it."""
    ok = ~F.col("failed") & ~F.col("empty")
    g = candidates.groupBy("request_id").agg(F.min_by("parser_id", F.when(ok, F.col("ord"))).alias("selected"), F.min(F.when(ok, F.col("ord"))).alias("at"), F.array_sort(F.collect_list(F.struct("ord", "parser_id", ok.alias("ok")))).alias("tries"))
    return g.select("request_id", "selected", F.transform(F.filter("tries", lambda t: F.col("at").isNull() | (t["ord"] <= F.col("at"))), lambda t: t["parser_id"]).alias("attempts"))
