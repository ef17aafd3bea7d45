"""Completeness, safety and provenance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.exprs import bbox_valid, blank, is_sha256, occurrences
from lithoframe.operators.model import CRITICAL, INFERRED, INFO, MANUAL, REJECTED, VERIFIED, WARNING, Facts, Result, issue, observe, union

#: fixed values: traces of text decoded with the wrong encoding
MOJIBAKE = ("Ã", "Â", "â€", "ðŸ", "ï¿½")


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def duplicates(blocks: DataFrame, column: str) -> DataFrame:
    """(doc_id, column, n, blocks): values that several blocks of a document share."""
    return blocks.filter(F.col(column).isNotNull()).groupBy("doc_id", column).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("block_id")).alias("blocks")).filter("n > 1")


def by_document(facts: Facts, found: DataFrame | None, *flags: Column) -> DataFrame:
    """documents with the flags of found, one row each, false where nothing was found."""
    agg = found.groupBy("doc_id").agg(*flags)
    names = [c for c in agg.columns if c != "doc_id"]
    return facts.documents.select("doc_id").join(agg, "doc_id", "left").select("doc_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def blocks_exist(f: Facts) -> Result:
    n = f.blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = f.documents.select("doc_id").join(n, "doc_id", "left")
    none = issue(d.filter("n is null"), "QL-CONT-001", CRITICAL, "content_completeness", F.lit("document has no blocks"))
    dup = duplicates(f.blocks, "block_id")
    repeated = issue(dup, "QL-CONT-001", CRITICAL, "content_completeness", text("duplicate block id ", F.col("block_id")), F.array("block_id"))
    bad = dup.select("doc_id").distinct().withColumn("dup", F.lit(True))
    s = d.join(bad, "doc_id", "left")
    ref = F.when(F.col("n").isNotNull(), F.array(F.lit("document.blocks"))).otherwise(F.array().cast("array<string>"))
    return Result(union(none, repeated), observe(s, "content_complete", F.when(F.col("n").isNull() | F.col("dup"), F.lit(REJECTED)).otherwise(VERIFIED), ref))


def order_index(f: Facts) -> Result:
    missing = f.blocks.filter("order_index is null").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("block_id")).alias("blocks"))
    dup = duplicates(f.blocks, "order_index")
    i = union(issue(missing, "QL-CONT-002", WARNING, "reading_order", text(F.col("n"), " blocks lack order_index"), F.col("blocks")), issue(dup, "QL-CONT-002", WARNING, "reading_order", text("order_index ", F.col("order_index"), " is shared by ", F.col("n"), " blocks"), F.col("blocks")))
    s = by_document(f, i, F.lit(True).alias("bad"))
    return Result(i, observe(s, "reading_order_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED)))


def kind_content(f: Facts) -> Result:
    b = f.blocks.join(f.tables.select("doc_id", "block_id", F.lit(True).alias("has_table")).distinct(), ["doc_id", "block_id"], "left")
    kinds = {
        "level": ((F.col("kind") == "heading") & F.col("heading_level").isNull(), WARNING, "heading_structure", " headings lack heading_level"),
        "table": ((F.col("kind") == "table") & F.col("has_table").isNull(), WARNING, "table_structure", " table blocks lack a table"),
        "empty": (F.col("kind").isin("paragraph", "heading") & blank(F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text")).otherwise(F.col("markdown"))), INFO, "content_completeness", " blocks are empty"),
    }
    a = b.groupBy("doc_id").agg(*[F.count_if(c).alias(k) for k, (c, *_) in kinds.items()], *[F.array_sort(F.collect_list(F.when(c, F.col("block_id")))).alias(f"{k}_blocks") for k, (c, *_) in kinds.items()])
    i = union(*[issue(a.filter(F.col(k) > 0), "QL-CONT-003", sev, cat, text(F.col(k), msg), F.col(f"{k}_blocks")) for k, (_, sev, cat, msg) in kinds.items()])
    s = f.documents.select("doc_id").join(a, "doc_id", "left")
    return Result(i, observe(s, "kind_content_consistent", F.when((F.col("level") > 0) | (F.col("table") > 0), MANUAL).when(F.col("empty") > 0, INFERRED).otherwise(VERIFIED)))


def empty_content(f: Facts) -> Result:
    n = f.blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list("block_id")).alias("blocks"))
    return Result(issue(f.documents.filter(blank(F.col("markdown"))).join(n, "doc_id"), "QL-CONT-004", CRITICAL, "content_completeness", F.lit("normalised content is blank"), F.col("blocks")))


def mojibake_counts(markdown: Column) -> dict[str, Column]:
    m = F.coalesce(markdown, F.lit(""))
    marks = occurrences(m, MOJIBAKE[0])
    for x in MOJIBAKE[1:]:
        marks = marks + occurrences(m, x)
    return {"n_replacement": occurrences(m, "�"), "n_markers": marks, "n_control": F.regexp_count(m, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).cast("long")}


def mojibake(f: Facts) -> Result:
    d = f.documents.select("doc_id", *[c.alias(k) for k, c in mojibake_counts(F.col("markdown")).items()]).filter("n_replacement >= 2 or n_markers >= 2 or n_control > 0")
    hit = F.col("markdown").contains("�")
    for x in MOJIBAKE:
        hit = hit | F.col("markdown").contains(x)
    b = f.blocks.filter(hit).groupBy("doc_id").agg(F.array_sort(F.collect_list("block_id")).alias("blocks"))
    why = F.concat_ws(", ", *[F.when(F.col(k) > 0, text(F.col(k), f" {n}")) for k, n in (("n_replacement", "replacement characters"), ("n_markers", "encoding marks"), ("n_control", "control characters"))])
    return Result(issue(d.join(b, "doc_id", "left"), "QL-FMT-001", CRITICAL, "content_readability", text("unreadable text: ", why), F.coalesce("blocks", F.array().cast("array<string>"))))


def data_uri(f: Facts) -> Result:
    d = f.documents.withColumn("n", F.regexp_count("markdown", F.lit(r"(?i)data:image/[^,\s]+,"))).filter("n > 0")
    b = f.blocks.filter(F.lower("markdown").contains("data:image/")).groupBy("doc_id").agg(F.array_sort(F.collect_list("block_id")).alias("blocks"))
    return Result(issue(d.join(b, "doc_id", "left"), "QL-ASSET-001", CRITICAL, "asset_integrity", text(F.col("n"), " data URIs remain"), F.coalesce("blocks", F.array().cast("array<string>"))))


def image_references(documents: DataFrame) -> DataFrame:
    """(doc_id, ref): image links of the Markdown that should be local assets, repeats included."""
    r = documents.select("doc_id", F.explode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))).alias("ref"))
    return r.filter(~F.lower("ref").rlike("^(http://|https://|data:)"))


def local_references(f: Facts) -> Result:
    have = f.assets.select("doc_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("p")).distinct()
    miss = image_references(f.documents).withColumn("p", F.replace("ref", F.lit("\\"), F.lit("/"))).join(have, ["doc_id", "p"], "left_anti")
    a = miss.groupBy("doc_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("ref")), 1, 50).alias("paths"))
    return Result(issue(a, "QL-ASSET-002", WARNING, "asset_integrity", text(F.col("n"), " image links lack an asset: ", F.array_join("paths", " "))))


def source_traceable(f: Facts) -> Result:
    gone = f.blocks.filter("coalesce(source_block_id, '') = ''").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("block_id")).alias("blocks"))
    dup = duplicates(f.blocks.filter("source_block_id <> ''"), "source_block_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    i = union(issue(gone, "QL-PROV-001", WARNING, "provenance", text(F.col("n"), " blocks lack source_block_id"), F.col("blocks")), issue(dup, "QL-PROV-001", WARNING, "provenance", text(F.col("n"), " source_block_ids are shared"), F.col("blocks")))
    s = by_document(f, i, F.lit(True).alias("bad"))
    return Result(i, observe(s, "provenance_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED), F.array(F.lit("document.blocks[].source_block_id"))))


def anchors_valid(f: Facts) -> Result:
    b = f.blocks
    bad = b.filter(F.col("bbox").isNotNull() & ~bbox_valid(F.col("bbox"), F.col("coordinate_system")))
    claimed = b.filter("bbox is null and coalesce(bbox_granularity, '') <> ''")
    t = f.tables.filter(F.col("bbox").isNotNull() & ~bbox_valid(F.col("bbox"), F.lit(None).cast("string")))
    i = union(
        issue(bad, "QL-PROV-002", WARNING, "provenance", text("block box is invalid: ", F.to_json("bbox")), F.array("block_id")),
        issue(claimed, "QL-PROV-002", WARNING, "provenance", text("granularity ", F.col("bbox_granularity"), " without a box"), F.array("block_id")),
        issue(t, "QL-PROV-002", WARNING, "provenance", text("table ", F.col("table_id"), " box is invalid"), F.array("block_id")),
    )
    s = by_document(f, i, F.lit(True).alias("bad"))
    return Result(i, observe(s, "provenance_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED)))


def artifacts_valid(f: Facts) -> Result:
    a = issue(f.assets.filter(~is_sha256(F.col("sha256"))), "QL-PROV-003", WARNING, "provenance", text("asset ", F.col("path"), " lacks a sha256"))
    n = issue(f.artifacts.filter(~is_sha256(F.col("sha256"))), "QL-PROV-003", F.when(F.col("required"), CRITICAL).otherwise(WARNING), "provenance", text("artifact ", F.col("artifact_id"), " lacks a sha256"))
    i = union(a, n)
    s = by_document(f, i, F.bool_or(F.col("severity") == CRITICAL).alias("c"), F.bool_or(F.col("severity") == WARNING).alias("w"))
    return Result(i, observe(s, "provenance_reliable", F.when(F.col("c"), REJECTED).when(F.col("w"), MANUAL).otherwise(VERIFIED)))


def capability_reasons(f: Facts) -> Result:
    bad = f.capabilities.filter("state in ('partial', 'unavailable', 'failed') and coalesce(reason, '') = ''")
    i = issue(bad, "QL-PROV-004", CRITICAL, "provenance", text("capability ", F.col("name"), " is ", F.col("state"), " without a reason"))
    s = by_document(f, i, F.lit(True).alias("bad"))
    return Result(i, observe(s, "capability_declaration_valid", F.when(F.col("bad"), REJECTED).otherwise(VERIFIED)))
