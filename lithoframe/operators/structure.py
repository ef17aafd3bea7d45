"""Heading trees and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import expand_marker, heading_text, markers, numbered_level, strip
from lithoframe.functions.session import materialized
from lithoframe.operators.content import text
from lithoframe.operators.model import INFERRED, INFO, MANUAL, UNAVAILABLE, VERIFIED, WARNING, Facts, Result, issue, observe, union

DEEPEST = 16
#: fixed values: headings of a bibliography, remarks about citing, kinds that hold entries
REFERENCE_HEADING = r"(?i)^(?:参考文献|references?|bibliography|文献)$"
EXPLANATORY = r"引用规则|指向参考文献|分别指|指第"
ENTRY_KINDS = ("paragraph", "reference", "list")


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks with rn: reading order, no order first, ties by id."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("order_index", F.lit(-1)), "block_id")
    return blocks.withColumn("rn", F.row_number().over(w))


def order_conflicts(blocks: DataFrame) -> DataFrame:
    """(doc_id): documents in which blocks share an order_index."""
    return blocks.filter("order_index is not null").groupBy("doc_id", "order_index").count().filter("count > 1").select("doc_id").distinct()


def heading_fields(f: Facts) -> Result:
    h = f.blocks.filter("kind = 'heading'")
    bad = h.filter(F.col("heading_level").isNull() & numbered_level(heading_text(F.col("text"), F.col("markdown"))).isNull())
    a = bad.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("block_id")).alias("blocks"))
    i = issue(a, "QL-HDG-001", WARNING, "heading_structure", text(F.col("n"), " headings have neither level nor number"), F.col("blocks"))
    s = f.documents.select("doc_id").join(a, "doc_id", "left")
    return Result(i, observe(s, "heading_structure_evidence", F.when(F.col("n").isNotNull(), MANUAL).otherwise(VERIFIED)))


def heading_tree(blocks: DataFrame) -> DataFrame:
    """A row per heading: effective level, its source, the parent, and whether an orphan came before.

    The parent is the nearest earlier heading of a smaller level. For each depth the last position of a
    heading at most that deep is a running maximum, so the cost is linear; levels beyond DEEPEST count as it.
    """
    doc = Window.partitionBy("doc_id")
    h = ordered(blocks).filter("kind = 'heading'").withColumn("title", heading_text(F.col("text"), F.col("markdown")))
    h = h.withColumn("numbered", numbered_level(F.col("title")))
    level_doc = Window.partitionBy("doc_id", "heading_level")
    h = h.withColumn("spread", F.when(F.col("heading_level").isNotNull(), F.min("numbered").over(level_doc) < F.max("numbered").over(level_doc)))
    uniform = (F.min("heading_level").over(doc) == F.max("heading_level").over(doc)) & (F.count("*").over(doc) > 1)
    h = h.withColumn("rebuild", F.coalesce(F.bool_or("spread").over(doc), F.lit(False)) | F.coalesce(uniform, F.lit(False)))
    h = h.withColumn("first", F.row_number().over(doc.orderBy("rn")) == 1)
    level, numbered = F.col("heading_level"), F.col("numbered")
    root = F.col("rebuild") & F.col("first")
    h = h.withColumn("level", F.when(F.col("rebuild"), F.coalesce(numbered, level, F.when(root, F.lit(1)))).otherwise(F.coalesce(level, numbered)))
    h = h.withColumn("level_source", F.when(F.col("rebuild"), F.when(numbered.isNotNull(), "numbering").when(level.isNotNull(), "parser_level_fallback").otherwise("document_root")).otherwise(F.when(level.isNotNull(), "parser_level").otherwise("numbering")))
    h = h.withColumn("depth", F.when(F.col("level").isNotNull(), F.least("level", F.lit(DEEPEST))))
    before = doc.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("depth") <= k, F.struct("rn", "block_id", "level", "order_index", "source_block_id"))).over(before) for k in range(1, DEEPEST)]
    h = h.withColumn("parent", F.when(F.col("depth") > 1, F.get(F.array(*last), F.col("depth") - 2)))
    h = h.withColumn("orphan", F.col("level").isNotNull() & (F.col("level") > 1) & F.col("parent").isNull())
    return h.withColumn("orphan_before", F.coalesce(F.bool_or("orphan").over(before), F.lit(False)))


def build_tree(f: Facts) -> Result:
    h = materialized(heading_tree(f.blocks).join(order_conflicts(f.blocks).withColumn("conflict", F.lit(True)), "doc_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))))
    t = F.substring("title", 1, 30)
    per_doc = h.groupBy("doc_id").agg(F.array_sort(F.collect_list("block_id")).alias("blocks"), F.first("rebuild").alias("rebuild"), F.first("conflict").alias("conflict"))
    # documents in conflict without any heading have the conflict too
    conflict = order_conflicts(f.blocks).join(per_doc.select("doc_id", "blocks"), "doc_id", "left").select("doc_id", F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"))
    jump = F.col("level") > F.col("parent.level") + 1
    one = F.array("block_id")
    i = union(
        issue(conflict, "QL-HDG-004", WARNING, "reading_order_conflict", F.lit("headings share an order_index"), F.col("blocks")),
        issue(per_doc.filter("rebuild"), "QL-HDG-004", INFO, "heading_level_granularity_suspect", F.lit("heading levels come from numbers"), F.col("blocks")),
        issue(h.filter("level is null"), "QL-HDG-004", WARNING, "heading_level_missing", text("no level: ", t), one),
        issue(h.filter("orphan"), "QL-HDG-004", WARNING, "heading_parent_missing", text("no parent at level ", F.col("level"), ": ", t), one),
        issue(h.filter(F.col("parent").isNotNull() & jump), "QL-HDG-004", INFO, "heading_level_jump", text("level ", F.col("parent.level"), " to ", F.col("level"), ": ", t), F.array("parent.block_id", "block_id")),
    )
    p = F.col("parent")
    traced = p["order_index"].isNotNull() & F.col("order_index").isNotNull() & (F.coalesce(p["source_block_id"], F.lit("")) != "") & (F.coalesce("source_block_id", F.lit("")) != "")
    state = F.when(F.col("conflict") | F.col("orphan_before"), MANUAL).when(jump | (F.col("level_source") != "parser_level") | ~traced, INFERRED).otherwise(VERIFIED)
    r = h.filter("parent is not null").select("doc_id", F.lit("parent_child").alias("relation_type"), p["block_id"].alias("from_id"), F.col("block_id").alias("to_id"), state.alias("state"), F.lit("").alias("marker_key"))
    c = r.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == VERIFIED).alias("v"), F.bool_or(F.col("state") == MANUAL).alias("m"), F.array_sort(F.collect_set(F.concat("from_id", F.lit(".heading_level")))).alias("refs"))
    bad = i.filter("category in ('reading_order_conflict', 'heading_parent_missing')").select("doc_id").distinct().withColumn("bad", F.lit(True))
    s = c.join(bad, "doc_id", "full_outer")
    none = F.array().cast("array<string>")
    return Result(i, observe(s, "heading_tree_reliable", F.when(F.col("bad"), MANUAL).when(F.col("v") == F.col("n"), VERIFIED).when(F.col("m"), MANUAL).otherwise(INFERRED), F.coalesce("refs", none)), r)


def section_paths(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, path): titles of the headings above each block, its own included, in order."""
    doc = Window.partitionBy("doc_id")
    b = ordered(blocks).withColumn("title", F.when(F.col("kind") == "heading", heading_text(F.col("text"), F.col("markdown"))))
    upto = doc.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    lvl = F.when(F.col("heading_level").isNotNull(), F.least(F.col("heading_level"), F.lit(DEEPEST)))
    for k in range(1, DEEPEST + 1):
        b = b.withColumn(f"l{k}", F.max(F.when(F.col("title").isNotNull() & (lvl == k), F.struct("rn", "title"))).over(upto)).withColumn(f"c{k}", F.max(F.when(F.col("title").isNotNull() & (lvl < k), F.col("rn"))).over(upto))
    keep = F.array_compact(F.array(*[F.when(F.col(f"l{k}.rn") > F.coalesce(f"c{k}", F.lit(0)), F.col(f"l{k}.title")) for k in range(1, DEEPEST + 1)]))
    return b.select("doc_id", "block_id", keep.alias("path"))


# ---- references


def block_text(heading: bool = False):
    return heading_text(F.col("text"), F.col("markdown")) if heading else strip(F.coalesce("text", "markdown", F.lit("")))


def reference_blocks(blocks: DataFrame) -> DataFrame:
    """Ordered blocks with ref_rn, the first reference heading's place, and end_rn, the next heading's."""
    doc = Window.partitionBy("doc_id")
    head = F.col("kind") == "heading"
    b = ordered(blocks).withColumn("body", block_text())
    b = b.withColumn("ref_rn", F.min(F.when(head & block_text(True).rlike(REFERENCE_HEADING), F.col("rn"))).over(doc))
    return b.withColumn("end_rn", F.min(F.when(head & (F.col("rn") > F.col("ref_rn")), F.col("rn"))).over(doc))


def reference_index(rb: DataFrame) -> DataFrame:
    """(doc_id, key, block_id, source_block_id, body): entries with their labels; unlabelled ones count on."""
    e = rb.filter((F.col("rn") > F.col("ref_rn")) & (F.col("end_rn").isNull() | (F.col("rn") < F.col("end_rn"))) & F.col("kind").isin(*ENTRY_KINDS) & (F.col("body") != "") & ~F.col("body").rlike(EXPLANATORY))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("rn"))
    given = F.nullif(F.regexp_extract(F.coalesce("label", F.lit("")), r"\d+", 0), F.lit(""))
    shape = r"^\s*(?:\[(\d+)\]|(\d+)[\.、)）])\s*"
    marked = F.nullif(F.concat(F.regexp_extract("body", shape, 1), F.regexp_extract("body", shape, 2)), F.lit(""))
    return e.withColumn("n", n).select("doc_id", F.coalesce(given, marked, F.col("n").cast("string")).alias("key"), "block_id", "source_block_id", "body")


def build_reference_index(f: Facts) -> Result:
    rb = reference_blocks(f.blocks)
    has = rb.groupBy("doc_id").agg(F.max("ref_rn").alias("ref_rn"))
    n = reference_index(rb).groupBy("doc_id").agg(F.count("*").alias("n"))
    s = f.documents.select("doc_id").join(has, "doc_id", "left").join(n, "doc_id", "left")
    i = issue(s.filter("ref_rn is not null and n is null"), "QL-REF-001", INFO, "reference_structure", F.lit("a reference heading without entries"))
    return Result(i, observe(s, "reference_index_built", F.when(F.col("n") > 0, VERIFIED).otherwise(UNAVAILABLE)))


def citations(rb: DataFrame) -> DataFrame:
    """(doc_id, block_id, source_block_id, marker, at, labels): markers before the bibliography that are no links."""
    b = rb.filter((F.col("ref_rn").isNull() | (F.col("rn") < F.col("ref_rn"))) & F.col("kind").isin(*ENTRY_KINDS) & ~F.col("body").rlike(EXPLANATORY))
    m = b.select("doc_id", "block_id", "source_block_id", F.explode(markers(F.col("body"))).alias("m")).select("doc_id", "block_id", "source_block_id", "m.*")
    w = Window.partitionBy("doc_id", "block_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("at", F.sum(F.col("gap") + F.length("marker")).over(w) - F.length("marker"))
    m = m.filter((F.col("before") != "!") & ~F.col("after").rlike(r"^\s*\("))
    m = m.withColumn("labels", expand_marker(F.regexp_extract("marker", r"^\[(.*)\]$", 1)))
    return m.filter(F.size("labels") > 0).select("doc_id", "block_id", "source_block_id", "marker", "at", F.transform("labels", lambda x: x.cast("string")).alias("labels"))


def bound_citations(rb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per marker: missing, ambiguous), (per marker and label of wholly bound markers: the entry)."""
    entries = reference_index(rb).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min_by(F.struct("block_id", "source_block_id"), "block_id").alias("entry"))
    c = citations(rb).select("*", F.posexplode("labels").alias("k", "key")).join(entries, ["doc_id", "key"], "left")
    w = Window.partitionBy("doc_id", "block_id", "at")
    c = c.withColumns({"n_missing": F.count_if(F.col("n").isNull()).over(w), "n_ambiguous": F.count_if(F.col("n") > 1).over(w)})
    per = c.groupBy("doc_id", "block_id", "marker", "at").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("k", "key")))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("k", "key")))).alias("ambiguous"))
    return per, c.filter("n_missing = 0 and n_ambiguous = 0")


def bind_citations(f: Facts) -> Result:
    rb = materialized(reference_blocks(f.blocks))
    per, bound = (materialized(x) for x in bound_citations(rb))
    conflict = order_conflicts(f.blocks)
    i = union(
        issue(conflict, "QL-REF-004", WARNING, "reading_order_conflict", F.lit("citations are bound in an uncertain order")),
        issue(per.filter(F.size("missing") > 0), "QL-REF-004", WARNING, "citation_binding", text(F.col("marker"), " lacks entries: ", F.array_join("missing.key", ", ")), F.array("block_id")),
        issue(per.filter(F.size("ambiguous") > 0), "QL-REF-004", WARNING, "ambiguous_target", text(F.col("marker"), " has several entries: ", F.array_join("ambiguous.key", ", ")), F.array("block_id")),
    )
    b = bound.join(conflict.withColumn("conflict", F.lit(True)), "doc_id", "left")
    traced = (F.coalesce("source_block_id", F.lit("")) != "") & (F.coalesce("entry.source_block_id", F.lit("")) != "")
    r = b.select("doc_id", F.lit("reference_of").alias("relation_type"), F.col("block_id").alias("from_id"), F.col("entry.block_id").alias("to_id"), F.when(F.col("conflict"), MANUAL).when(~traced, INFERRED).otherwise(VERIFIED).alias("state"), text(F.col("at"), ":", F.col("marker")).alias("marker_key"))
    c = r.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == VERIFIED).alias("v"))
    bad = i.groupBy("doc_id").agg(F.lit(True).alias("bad"))
    s = reference_index(rb).select("doc_id").distinct().join(c, "doc_id", "left").join(bad, "doc_id", "left")
    return Result(i, observe(s, "non_table_relation_reliable", F.when(F.col("v") == F.col("n"), VERIFIED).when((F.col("n") > 0) | F.col("bad"), MANUAL).otherwise(UNAVAILABLE)), r)
