"""Fidelity analytics over sources and several parsers' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import alnum_key, strip

#: fixed values: sampling buckets with their quotas, and the formats that a trimmed sample keeps first
BUCKETS = (("format_doc", 2), ("format_docx", 2), ("format_ppt", 2), ("format_xls", 2), ("format_xlsx", 1), ("ordinary_text_pdf", 3), ("scanned_ocr_pdf", 3), ("image_rich", 3), ("complex_table", 3), ("split_document", 2), ("parser_failure", 3), ("empty_pseudo_success", 3), ("data_uri", 2))
MODEL_PRIORITY = {"mineru": 4, "docling": 3, "anydoc": 2, "markitdown": 1}
ANCHOR = 24


IMAGE_CATEGORY = "图文回答数据集源文件"  # fixed value: the category of sources that are pictures with questions


def markdown_lines(docs: DataFrame, key: str = "doc_id", md: str = "markdown") -> DataFrame:
    """(key, n, line, block): lines with the number of the Markdown block that they belong to (null: blank).

    A block ends at a blank line outside fenced code, and before and after a heading.
    """
    l = docs.select(key, F.posexplode(F.split(md, r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    s = strip(F.col("line"))
    l = l.withColumn("mark", s.rlike(r"^(```+|~~~+)"))
    l = l.withColumn("fenced", F.sum(F.col("mark").cast("int")).over(w) % 2 == 1)
    l = l.withColumn("head", ~F.col("fenced") & s.startswith("#")).withColumn("gap", ~F.col("fenced") & (s == ""))
    start = F.col("head") | (~F.col("gap") & F.coalesce(F.lag(F.col("head") | F.col("gap")).over(w), F.lit(True)))
    return l.withColumn("block", F.when(~F.col("gap"), F.sum(start.cast("int")).over(w))).select(key, "n", "line", "block")


def markdown_metrics(docs: DataFrame, assets: DataFrame | None = None, key: str = "doc_id", md: str = "markdown") -> DataFrame:
    """Characters, lines, blocks, headings, tables, links, duplicate and largest blocks of each Markdown text."""
    l = markdown_lines(docs, key, md)
    b = l.filter("block is not null").groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("t")).withColumn("t", strip(F.col("t")))
    same = b.filter("t <> ''").groupBy(key, alnum_key(F.col("t")).alias("k")).agg(F.count("*").alias("c"), F.max(F.length("t")).alias("m"))
    d = same.groupBy(key).agg(F.sum("c").alias("blocks"), F.sum(F.when((F.col("c") > 1) & (F.col("k") != ""), F.col("c") - 1).otherwise(0)).alias("duplicate_blocks"), F.max("m").alias("largest"))
    t = F.coalesce(F.col(md), F.lit(""))
    refs = F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\(([^\)]+)\)"), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    is_data = lambda r: F.lower(r).startswith("data:image/")
    is_web = lambda r: F.lower(r).rlike("^https?://")
    m = docs.select(key, F.length(t).cast("long").alias("chars"), F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\r?\n$", ""), r"\r?\n"))).cast("long").alias("lines"), F.sha2(t, 256).alias("sha256"), count(r"(?m)^#{1,6}\s+\S").alias("headings"), count(r"(?is)<table\b").alias("html_tables"), count(r"(?m)^[ \t]*\|.*\|[ \t]*$").alias("pipe_rows"), F.size(refs).cast("long").alias("image_refs"), F.size(F.filter(refs, is_data)).cast("long").alias("data_uris"), F.size(F.filter(refs, is_web)).cast("long").alias("external_refs"), (strip(t) == "").alias("is_empty"))
    if assets is not None:
        local = docs.select(key, F.explode(F.filter(refs, lambda r: ~is_data(r) & ~is_web(r))).alias("r")).withColumn("path", F.regexp_replace("r", r"[#?].*$", ""))
        miss = local.join(assets.select(key, "path").distinct(), [key, "path"], "left_anti").groupBy(key).agg(F.count("*").alias("missing_refs"))
        m = m.join(miss, key, "left").withColumn("missing_refs", F.coalesce("missing_refs", F.lit(0)))
    m = m.join(d, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("blocks", "duplicate_blocks", "largest")})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    giant = (F.col("largest") >= 10_000) | ((F.col("chars") >= 1000) & (F.col("largest") * 10 >= F.col("chars") * 8))
    return m.withColumns({"duplicate_ratio": ratio("duplicate_blocks", "blocks"), "largest_share": ratio("largest", "chars"), "giant": giant})


def text_fidelity(pairs: DataFrame, key: str = "doc_id", source: str = "source_text", output: str = "output_text") -> DataFrame:
    """Share of sampled 24-character anchors of the source that the output has, and whether they keep their order."""
    n = pairs.select(key, alnum_key(F.coalesce(F.col(source), F.lit(""))).alias("s"), alnum_key(F.coalesce(F.col(output), F.lit(""))).alias("o"))
    size = F.length("s")
    step = F.greatest(F.lit(ANCHOR), F.floor(size / F.least(F.lit(200), F.greatest(F.lit(20), F.floor(size / 500))))).cast("int")
    at = F.sequence(F.lit(0), F.greatest(size - ANCHOR, F.lit(0)), step)
    a = F.filter(F.transform(at, lambda p: F.struct(p.alias("p"), F.substring(F.col("s"), p + 1, F.lit(ANCHOR)).alias("t"))), lambda x: F.length(x["t"]) >= 12)
    n = n.withColumn("a", F.when((size > 0) & (F.length("o") > 0), a))
    n = n.withColumn("m", F.filter(F.transform("a", lambda x: F.call_function("instr", F.col("o"), x["t"])), lambda p: p > 0))
    rising = F.size(F.filter(F.transform("m", lambda p, i: (i > 0) & (p >= F.get(F.col("m"), i - 1))), lambda x: x))
    k, hit = F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("m"), F.lit(0))
    k, hit = F.greatest(k, F.lit(0)), F.greatest(hit, F.lit(0))
    ok = size > 0
    zero = F.length("o") == 0
    return n.select(key, ok.alias("available"), size.cast("long").alias("source_chars"), F.length("o").cast("long").alias("output_chars"), F.when(ok, k).cast("long").alias("anchors"), F.when(ok, hit).cast("long").alias("matched"), F.when(ok & zero, 0.0).when(ok & (k > 0), F.round(hit / k, 6)).alias("coverage"), F.when(ok & zero, 0.0).when(ok & (hit > 1), F.round(rising / (hit - 1), 6)).alias("order_score"), F.when(ok, F.round(F.length("o") / size, 6)).alias("length_ratio"))


def numeric_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, extremes, mean and interpolated quartiles; nulls don't count."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), q.alias("q"), F.max(v).alias("hi"), F.avg(v).alias("m"))
    r = lambda c: F.round(c, 6)
    return g.select(*keys, "n", r(F.col("lo")).alias("min"), r(F.get("q", F.lit(0))).alias("p25"), r(F.get("q", F.lit(1))).alias("median"), r(F.get("q", F.lit(2))).alias("p75"), r(F.col("hi")).alias("max"), r(F.col("m")).alias("mean"))


def coverage(blocks: DataFrame, *keys: str) -> DataFrame:
    """Share of blocks with page, box and source id, and the number of different pages."""
    has = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)
    return blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("page_number").alias("pages"), has("page_number").alias("page_share"), has("bbox").alias("box_share"), has("source_block_id").alias("source_share"))


def scenarios(ext: Column, scanned: Column, images: Column, tables: Column, cells: Column, pages: Column, split: Column, failed: Column, empty: Column, data_uris: Column, giant: Column, media: Column | None = None, category: Column | None = None, detected: Column | None = None) -> Column:
    """Sorted scenario tags of a source; detected: the number of tables that each parser found."""
    z = lambda c: F.coalesce(c, F.lit(0))
    media, category = F.lit(0) if media is None else media, F.lit("") if category is None else category
    second = F.lit(0) if detected is None else F.when(F.size(detected) >= 2, F.get(F.sort_array(F.transform(detected, z), False), F.lit(1)))
    pdf = ext == ".pdf"
    tags = [
        F.concat(F.lit("format_"), F.regexp_replace(ext, r"^\.", "")),
        F.when(pdf & (scanned >= 0.8), "scanned_ocr_pdf"), F.when(pdf & (scanned <= 0.2), "ordinary_text_pdf"), F.when(pdf & ~F.coalesce((scanned >= 0.8) | (scanned <= 0.2), F.lit(False)), "mixed_text_scan_pdf"),
        F.when((z(images) >= 5) | (z(media) > 0) | (F.coalesce(category, F.lit("")) == IMAGE_CATEGORY), "image_rich"), F.when((z(tables) >= 3) | (z(cells) >= 100) | (z(second) >= 3), "complex_table"), F.when(ext.isin(".doc", ".ppt", ".xls"), "legacy_office"), F.when(pages >= 200, "very_long_document"),
        F.when(split, "split_document"), F.when(failed, "parser_failure"), F.when(empty, "empty_pseudo_success"), F.when(z(data_uris) > 0, "data_uri"), F.when(giant, "giant_block"),
    ]
    return F.array_sort(F.array_compact(F.array(*tags)))


#: fixed values: the rated capabilities, in order
RATED = ("text_fidelity", "reading_order", "page_traceability", "table_fidelity", "image_fidelity", "heading_structure", "ocr_quality")


def capability_ratings(records: DataFrame) -> DataFrame:
    """records with ratings: a struct of good, partial, failed or not_applicable for each of RATED.

    records: ext, scenarios, source_pages; parser_success, is_empty; proxy_available, coverage, order_score, length_ratio;
    page_coverage; table_count, table_cells, html_tables, pipe_rows; references, missing_references, assets, pictures;
    headings, blocks, chars of one parser's output on one source.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    no, pdf = F.lit("not_applicable"), F.col("ext") == ".pdf"
    marked = lambda tag: F.array_contains("scenarios", tag)
    steps = lambda score, good, partial: F.when(score >= good, "good").when(score >= partial, "partial").otherwise("failed")
    proxy = is_true("proxy_available")
    alive = {
        "text_fidelity": F.when(~proxy, no).when((F.col("coverage") >= 0.8) & F.col("length_ratio").between(0.6, 1.8), "good").when(F.col("coverage") >= 0.3, "partial").otherwise("failed"),
        "reading_order": F.when(~proxy | F.col("order_score").isNull(), no).otherwise(steps(F.col("order_score"), 0.95, 0.6)),
        "page_traceability": F.when(~pdf | F.col("source_pages").isNull(), no).when(F.col("page_coverage") >= 0.95, "good").when(F.col("page_coverage") > 0, "partial").otherwise("failed"),
        "table_fidelity": F.when(~marked("complex_table"), no).when((z("table_cells") > 0) & (z("html_tables") + z("pipe_rows") > 0), "good").when((z("table_count") > 0) | (z("html_tables") + z("pipe_rows") > 0), "partial").otherwise("failed"),
        "image_fidelity": F.when(~marked("image_rich"), no).when((z("references") > 0) & (z("missing_references") == 0), "good").when((z("references") > 0) | (z("assets") > 0) | (z("pictures") > 0), "partial").otherwise("failed"),
        "heading_structure": F.when(z("headings") >= 2, "good").when(z("blocks") > 0, "partial").otherwise("failed"),
        "ocr_quality": F.when(~marked("scanned_ocr_pdf"), no).when(z("chars") == 0, "failed").otherwise("partial"),
    }
    dead = {c: F.lit("failed") for c in RATED} | {"page_traceability": F.when(pdf, "failed").otherwise(no)} | {c: F.when(marked(tag), "failed").otherwise(no) for c, tag in (("table_fidelity", "complex_table"), ("image_fidelity", "image_rich"), ("ocr_quality", "scanned_ocr_pdf"))}
    gone = ~is_true("parser_success") | is_true("is_empty")
    return records.withColumn("ratings", F.struct(*[F.when(gone, dead[c]).otherwise(alive[c]).alias(c) for c in RATED]))


def rating(failed: Column, applicable: Column, score: Column, good: float, partial: float) -> Column:
    """good, partial or failed by a score's thresholds; not_applicable without evidence."""
    return F.when(~applicable, "not_applicable").when(failed, "failed").when(score.isNull(), "not_applicable").when(score >= good, "good").when(score >= partial, "partial").otherwise("failed")


def overridden(ratings: DataFrame, manual: DataFrame) -> DataFrame:
    """ratings (document_key, parser, capability, rating) with manual ones in their place, and the method."""
    k = ["document_key", "parser", "capability"]
    j = ratings.join(manual.select(*k, F.col("rating").alias("_m")), k, "left")
    return j.select(*k, F.coalesce("_m", "rating").alias("rating"), F.when(F.col("_m").isNotNull(), "manual_source_comparison").otherwise("evidence_triage").alias("method"))


def best_candidates(records: DataFrame, *keys: str) -> DataFrame:
    """The best of each source: usable, not empty, with assets, fewest critical issues, model priority, length."""
    prio = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_PRIORITY.items() for x in kv]), F.col("model")), F.lit(0))
    order = [F.col("usable").cast("int").desc(), F.col("nonempty").cast("int").desc(), (F.col("assets") > 0).cast("int").desc(), F.col("critical").asc(), prio.desc(), F.least("chars", F.lit(200_000)).desc(), F.col("model").asc()]
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def select_samples(records: DataFrame, wanted: int = 28, most: int = 32) -> DataFrame:
    """A small audit sample (document_key, reasons) of records (document_key, unique_source, scenarios, issues).

    Each bucket's best go in first, a content once; then the most troubled fill up; at most `most` rows stay.
    Only the candidates of buckets and fill, a bounded number, take part in the merging.
    """
    order = [F.size("scenarios").desc(), F.col("issues").desc(), F.lower("document_key")]
    b = F.broadcast(records.sparkSession.createDataFrame([(i, s, n) for i, (s, n) in enumerate(BUCKETS)], "bucket int, scenario string, quota int"))  # fixed buckets
    e = records.select("*", F.explode("scenarios").alias("scenario")).join(b, "scenario").withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter("rank <= quota")
    least = max(24, min(32, wanted))
    # the buckets take at most their quotas, so no more than this many are ever needed for the fill
    one = Window.partitionBy("unique_source").orderBy(F.col("issues").desc(), F.size("scenarios").desc(), F.lower("document_key"))
    fill = records.withColumn("_o", F.row_number().over(one)).filter("_o = 1").orderBy(F.col("issues").desc(), F.size("scenarios").desc(), F.lower("document_key")).limit(least + sum(n for _, n in BUCKETS))
    cols = ["document_key", "unique_source", "scenarios", "issues", "bucket", "rank", "scenario"]
    f = fill.withColumns({"bucket": F.lit(len(BUCKETS)), "scenario": F.lit("anomaly_diversity_fill"), "rank": F.row_number().over(Window.orderBy(F.col("issues").desc(), F.size("scenarios").desc(), F.lower("document_key")))})
    u = e.select(*cols).unionByName(f.select(*cols))
    # the first pick of a content carries all its reasons
    first = Window.partitionBy("unique_source").orderBy("bucket", "rank")
    u = u.withColumns({"key": F.first("document_key").over(first), "first_bucket": F.first("bucket").over(first), "first_rank": F.first("rank").over(first)})
    g = u.groupBy("unique_source", "key", "first_bucket", "first_rank").agg(F.array_sort(F.collect_set(F.when(F.col("bucket") < len(BUCKETS), F.col("scenario")))).alias("reasons"))
    g = g.withColumn("n", F.row_number().over(Window.orderBy("first_bucket", "first_rank")))
    g = g.filter((F.col("first_bucket") < len(BUCKETS)) | (F.col("n") <= least)).withColumn("reasons", F.when(F.col("first_bucket") == len(BUCKETS), F.array(F.lit("anomaly_diversity_fill"))).otherwise(F.col("reasons")))
    need = F.exists("reasons", lambda r: r.startswith("format_"))
    return g.orderBy(~need, F.size("reasons").desc(), F.lower("key")).limit(most).select(F.col("key").alias("document_key"), "reasons")
