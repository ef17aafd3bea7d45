"""Further joins, aggregations, rules and checks, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions import exprs as x
from lithoframe.operators import audit, content, gate, matching, repairs, routing, structure, tables, validation
from lithoframe.operators.model import Facts, last_blocks
from lithoframe.plans.rules import DRIFT_SQL, TEXT_SQL, TREE_SQL, digest
from lithoframe.sources.lift import TABLE_SQL, heading_facts, table, table_facts, text_facts


def nested_facts(spark, sf_dir) -> Facts:
    """orders as tables of sheets: row counts, view scopes and parents from the key; customers as documents."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    parent = F.lag(k).over(Window.partitionBy("o_custkey").orderBy(k))
    d = F.col("o_custkey").cast("string").alias("doc_id")
    t = o.join(size, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_p", parent).select(
        d, k.cast("string").alias("table_id"), k.cast("string").alias("block_id"), F.col("n").alias("num_rows"), F.when(k % 4 == 0, F.col("n") + 1).when(k % 4 == 1, F.col("n")).cast("int").alias("emitted_row_count"),
        F.when(k % 3 != 2, F.col("n") + k % 2).cast("int").alias("source_row_count"), F.when(k % 3 == 0, (k % 5).cast("int")).alias("hidden_row_count"), F.element_at(F.array(F.lit("all_rows"), F.lit("visible_rows"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("view_scope"),
        F.when(k % 6 == 5, F.col("_p").cast("string")).alias("parent_table_id"), F.when(k % 6 == 5, F.concat(F.col("_p").cast("string"), F.lit(":c"))).alias("parent_cell_id"), F.when(k % 12 == 5, 1).otherwise(0).alias("nesting_depth"),
        F.when(k % 7 == 0, "<table>x</table>").alias("html"), F.when(k % 7 == 1, "| a |").when(k % 7 == 2, " | b |").otherwise("| c |").alias("markdown"),
    )
    c = o.filter(k % 2 == 0).select(d, k.cast("string").alias("table_id"), F.concat(k.cast("string"), F.lit(":c")).alias("cell_id"), F.lit(0).alias("start_row"), F.lit(0).alias("start_col"), F.when(k % 8 == 0, 2).otherwise(1).alias("row_span"), F.lit(1).alias("col_span"), F.when(k % 16 == 0, "p\tq").when(k % 10 == 0, " ").otherwise("v").alias("text"))
    b = o.select(d, k.cast("string").alias("block_id"), F.when(k % 11 == 0, "paragraph").otherwise("table").alias("kind"), F.when(k % 13 == 0, "| z |").when(k % 7 == 1, "| a |").when(k % 7 == 2, "| b |").otherwise("| c |").alias("markdown"))
    docs = o.select(d).distinct().withColumn("markdown", F.lit("| a |\n| b |\n| c |"))
    return Facts(docs, b, t, c)


NESTED_SQL = """sz AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey),
nt AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS k, coalesce(n, 0) AS n, CASE WHEN o_orderkey % 4 = 0 THEN coalesce(n, 0) + 1 WHEN o_orderkey % 4 = 1 THEN coalesce(n, 0) END AS emitted, CASE WHEN o_orderkey % 3 <> 2 THEN coalesce(n, 0) + o_orderkey % 2 END AS source, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS hidden,
  CASE WHEN o_orderkey % 6 = 5 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent, CASE WHEN o_orderkey % 12 = 5 THEN 1 ELSE 0 END AS depth, ['all_rows', 'visible_rows', 'unknown'][o_orderkey % 3 + 1] AS scope FROM orders LEFT JOIN sz ON k = o_orderkey)"""


def evidence(spark, sf_dir) -> DataFrame:
    r = tables.evidence_integrity(nested_facts(spark, sf_dir))
    return r.issues.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


EVIDENCE_SQL = f"""WITH {NESTED_SQL}, i AS (SELECT doc_id, 'table_pseudo_nested' AS category FROM nt WHERE k % 16 = 0
UNION ALL SELECT doc_id, 'table_structure' FROM nt WHERE emitted <> n UNION ALL SELECT doc_id, 'table_view' FROM nt WHERE hidden > source
UNION ALL SELECT doc_id, 'table_view' FROM nt WHERE source IS NOT NULL AND ((scope = 'all_rows' AND emitted <> source) OR (scope = 'visible_rows' AND emitted + hidden <> source))
UNION ALL SELECT a.doc_id, 'table_structure' FROM nt a LEFT JOIN nt b ON b.k = a.parent WHERE a.parent IS NOT NULL AND NOT (b.k % 2 = 0 AND a.depth = b.depth + 1))
SELECT doc_id, category, count(*) AS n FROM i GROUP BY ALL"""


def empty_tables(spark, sf_dir) -> DataFrame:
    return tables.empty_tables(nested_facts(spark, sf_dir)).issues.select("doc_id", F.get("blocks", F.lit(0)).alias("block_id"))


def representation(spark, sf_dir) -> DataFrame:
    return tables.representation(nested_facts(spark, sf_dir)).issues.groupBy("doc_id", F.element_at(F.split("message", " "), 3).alias("what")).agg(F.count("*").alias("n"))


REPRESENTATION_SQL = """WITH t AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS k, CASE o_orderkey % 7 WHEN 1 THEN '| a |' WHEN 2 THEN '| b |' ELSE '| c |' END AS md, CASE WHEN o_orderkey % 13 = 0 THEN '| z |' WHEN o_orderkey % 7 = 1 THEN '| a |' WHEN o_orderkey % 7 = 2 THEN '| b |' ELSE '| c |' END AS b FROM orders),
i AS (SELECT doc_id, 'has' AS what FROM t WHERE k % 11 = 0 UNION ALL SELECT doc_id, 'differs' FROM t WHERE k % 11 <> 0 AND md <> b UNION ALL SELECT doc_id, 'isn''t' FROM t WHERE k % 11 <> 0 AND b = '| z |') SELECT doc_id, what, count(*) AS n FROM i GROUP BY ALL"""


def drift(spark, sf_dir) -> DataFrame:
    return tables.column_drift(table_facts(spark, sf_dir)).issues.groupBy("doc_id").agg(F.count("*").alias("n"))


def artifacts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = (k % 50).cast("string").alias("doc_id")
    sha = F.when(k % 5 != 0, F.sha2("p_name", 256)).otherwise(F.lit("zz")).alias("sha256")
    f = Facts(p.select(d).distinct().withColumn("markdown", F.lit("x")), assets=p.filter(k % 2 == 0).select(d, F.col("p_name").alias("path"), sha), artifacts=p.filter(k % 2 == 1).select(d, k.cast("string").alias("artifact_id"), sha, (k % 3 == 0).alias("required")))
    r = content.artifacts_valid(f)
    return r.observations.select("doc_id", "state").join(r.issues.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", "state", F.coalesce("n", F.lit(0)).alias("n"))


ARTIFACT_SQL = "WITH p AS (SELECT (p_partkey % 50)::VARCHAR AS doc_id, p_partkey % 5 = 0 AS bad, p_partkey % 2 = 1 AND p_partkey % 3 = 0 AS crit FROM part) SELECT doc_id, CASE WHEN bool_or(bad AND crit) THEN 'rejected' WHEN bool_or(bad) THEN 'manual_review_required' ELSE 'verified' END AS state, count(*) FILTER (bad) AS n FROM p GROUP BY doc_id"


def local_assets(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    f = Facts(p.select(F.col("page_id").cast("string").alias("doc_id"), F.concat(F.lit("![a](x\\"), F.col("page_id").cast("string"), F.lit(".png) ![b](y.png) ![c]("), "url", F.lit(")")).alias("markdown")), assets=p.filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("doc_id"), F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path")))
    return digest(f, content.local_references(f))


def separators(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    md = F.concat(F.lit("| a | b | c |\n|"), F.array_join(F.array_repeat(F.lit(":-"), (F.col("p_partkey") % 4 + 1).cast("int")), "|"), F.lit("|\n| "), "p_name", F.lit(" |"))
    return p.select("p_partkey", repairs.separators_aligned(md).alias("md"))


def relation_closure(spark, sf_dir) -> DataFrame:
    """JOIN-06: relations both of whose ends stay when every fourth heading is dropped."""
    f = heading_facts(spark, sf_dir)
    b = f.blocks.filter("order_index % 4 <> 3")
    return validation.closed_relations(structure.build_tree(f).relations, b).select("doc_id", "from_id", "to_id")


def sheets(spark, sf_dir) -> DataFrame:
    """JOIN-11: customers' orders as payload tables, matched to sheets that partly share their names and sizes."""
    o = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    k = F.col("o_orderkey")
    p = o.select(F.col("o_custkey").alias("book"), F.col("i").alias("table_no"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("name"), (k % 7).cast("int").alias("rows"), (k % 3).cast("int").alias("cols"))
    s = o.select(F.col("o_custkey").alias("book"), F.col("i").alias("sheet"), F.concat(F.lit("n"), (k % 4).cast("string")).alias("name"), (k % 7).cast("int").alias("rows"), (k % 6).cast("int").alias("visible"), (k % 3).cast("int").alias("cols"))
    return matching.match_sheets(p, s).select("book", "table_no", "sheet", "how")


SHEET_SQL = """WITH o AS (SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS k FROM orders),
t AS (SELECT book, i AS table_no, k % 5 AS name, k % 7 AS rows_, k % 3 AS cols_, row_number() OVER (PARTITION BY book, k % 5 ORDER BY i) AS n FROM o), s AS (SELECT book, i AS sheet, k % 4 AS name, k % 7 AS rows_, k % 6 AS vis, k % 3 AS cols_, row_number() OVER (PARTITION BY book, k % 4 ORDER BY i) AS n FROM o),
a AS (SELECT book, table_no, sheet FROM t JOIN s USING (book, name, n)), t2 AS (SELECT * FROM t WHERE (book, table_no) NOT IN (SELECT (book, table_no) FROM a)), s2 AS (SELECT * FROM s WHERE (book, sheet) NOT IN (SELECT (book, sheet) FROM a)),
f AS (SELECT t2.book, table_no, sheet, count(*) OVER (PARTITION BY t2.book, table_no) AS x, count(*) OVER (PARTITION BY t2.book, sheet) AS y FROM t2 JOIN s2 ON t2.book = s2.book AND t2.cols_ = s2.cols_ AND (t2.rows_ = s2.rows_ OR t2.rows_ = vis)),
b AS (SELECT book, table_no, sheet FROM f WHERE x = 1 AND y = 1), t3 AS (SELECT book, max(table_no) AS table_no FROM t2 WHERE (book, table_no) NOT IN (SELECT (book, table_no) FROM b) GROUP BY book HAVING count(*) = 1), s3 AS (SELECT book, max(sheet) AS sheet FROM s2 WHERE (book, sheet) NOT IN (SELECT (book, sheet) FROM b) GROUP BY book HAVING count(*) = 1)
SELECT *, 'name' AS how FROM a UNION ALL SELECT *, 'size' FROM b UNION ALL SELECT book, table_no, sheet, 'last' FROM t3 JOIN s3 USING (book)"""


def positions(spark, sf_dir) -> DataFrame:
    """JOIN-12: cells to the source row at their place."""
    li = table(spark, sf_dir, "lineitem")
    src = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("rows"))
    cells = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("row")).distinct()
    return matching.positional(cells, src, "l_orderkey").select("l_orderkey", "row", "source_row")


def ordinals(spark, sf_dir) -> DataFrame:
    """JOIN-17: each customer's orders (structured tables) and closed orders (rendered ones) zipped by ordinal where the numbers agree, with whether dates and prices are equal."""
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("p"))
    b = o.filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("other"), F.col("o_orderdate").alias("d2"), F.col("o_totalprice").alias("p2"))
    j = matching.paired_by_ordinal(a, b, "k", "o_orderkey", "other")
    return j.select("k", "o_orderkey", "other", ((F.col("d") == F.col("d2")) & (F.col("p") == F.col("p2"))).alias("equal"))


def manifests(spark, sf_dir) -> DataFrame:
    """JOIN-13, JOIN-14 and SRC-30: sources to outputs by normalised name, the last entry of a key wins; none is 'unparsed'."""
    p = table(spark, sf_dir, "part")
    m = matching.last_wins(p.filter("p_partkey % 3 <> 0").select(F.upper("p_name").alias("name"), "p_partkey", "p_brand"), "name", "p_partkey")
    k = x.window_name(F.concat(F.lit("D:\\in\\"), "p_name", F.lit(". ")))
    j = p.select("p_partkey", k.alias("key")).join(m.select(F.lower("name").alias("key"), F.col("p_brand").alias("status")), "key", "left")
    return j.select("p_partkey", F.coalesce("status", F.lit("unparsed")).alias("status"))


def asset_blocks(spark, sf_dir) -> DataFrame:
    """JOIN-16: the blocks that refer to each asset, as a sorted list."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").distinct()
    g = li.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda v: v.cast("string")), ",").alias("blocks"), F.count("*").alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey").join(g, "p_partkey", "left").select("p_partkey", F.coalesce("blocks", F.lit("")).alias("blocks"), F.coalesce("n", F.lit(0)).alias("n"))


def block_duplicates(spark, sf_dir) -> DataFrame:
    """AGG-01: ids that several blocks share, for the three kinds of id."""
    b = text_facts(spark, sf_dir).blocks
    parts = [content.duplicates(b, c).groupBy("doc_id").agg(F.lit(c).alias("kind"), F.count("*").alias("values"), F.sum("n").alias("blocks")) for c in ("block_id", "source_block_id", "order_index")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DUPLICATE_SQL = f"WITH {TEXT_SQL}, v AS (SELECT doc_id, 'block_id' AS kind, block_id AS v FROM blocks UNION ALL SELECT doc_id, 'source_block_id', source_block_id FROM blocks UNION ALL SELECT doc_id, 'order_index', order_index::VARCHAR FROM blocks) SELECT doc_id, kind, count(*) AS \"values\", sum(n)::BIGINT AS blocks FROM (SELECT doc_id, kind, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL"


def review(spark, sf_dir) -> DataFrame:
    """AGG-06: issues by scope and status."""
    r = tables.evidence_integrity(nested_facts(spark, sf_dir))
    return gate.review_summary(r.issues).select("doc_id", "scope", "n", F.col("n_manual_review_required").alias("manual"))


def replay_rollup(spark, sf_dir) -> DataFrame:
    """AGG-07: per model counts and a merged histogram of languages."""
    d = table(spark, sf_dir, "documents")
    h = d.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("docs"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("h"))
    return h.select("source", "docs", F.array_join(F.array_sort(F.transform(F.map_entries("h"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";").alias("langs"))


def corpus_summary(spark, sf_dir) -> DataFrame:
    """AGG-16 and AGG-20: totals of the corpus and of each language."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return d.rollup("lang").agg(F.count("*").alias("docs"), F.sum(F.length("t")).alias("chars"), F.countDistinct(F.sha2("t", 256)).alias("different"), F.count_if(F.length("t") < 100).alias("short"))


def implied_size(spark, sf_dir) -> DataFrame:
    """AGG-22: dimensions implied by cells where none are declared."""
    return tables.analysis(table_facts(spark, sf_dir)).filter("num_rows is null").select("table_id", F.col("rows").cast("long").alias("n_rows"), F.col("cols").cast("long").alias("n_cols"))


def contracts(spark, sf_dir) -> DataFrame:
    """VAL-03 and VAL-04: broken invariants of records."""
    li = table(spark, sf_dir, "lineitem")
    box = F.array(F.lit(0.0), F.col("l_quantity"), F.lit(10.0), F.col("l_extendedprice") / 90)
    e = matching.contract_errors(F.when(F.col("l_linenumber") != 2, box), F.when(F.col("l_partkey") % 3 == 0, "bad"), F.when(F.col("l_partkey") % 4 == 0, "../x").otherwise("a/b"), F.col("l_linenumber") - 2, F.col("l_tax") * 15)
    return li.select(F.array_join(e, ",").alias("errors")).groupBy("errors").agg(F.count("*").alias("n"))


def option_maps(spark, sf_dir) -> DataFrame:
    """SCAL-S25, PRJ-01, PRJ-03 and RTE-05: maps filled, stripped of secrets and derived."""
    k = F.col("p_partkey")
    m = F.create_map(F.lit("a"), k.cast("string"), F.lit("api_key"), F.lit("s"))
    d = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".png"), F.lit(".docx")), (k % 3 + 1).cast("int"))
    o = routing.parser_options(F.when(k % 2 == 0, "mineru").otherwise("docling"), ext, (k % 10) / 10.0, F.when(k % 5 == 0, "zh-CN").otherwise("de"))
    s = lambda mp: F.array_join(F.array_sort(F.transform(F.map_entries(mp), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return table(spark, sf_dir, "part").select("p_partkey", s(matching.filled(routing.without_secrets(m), d)).alias("filled"), s(o).alias("options"))


def outputs(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    t = F.length(F.coalesce("text", F.lit("")))
    cols = {"parser_success": d % 7 != 0, "is_empty": t < 100, "table_count": d % 2, "html_tables": F.when(d % 3 == 0, 1), "pipe_rows": d % 5, "pictures": d % 4, "references": d % 3, "split": d % 6 == 0, "merged": d % 4 == 0, "data_uris": t % 3, "missing_references": F.when(d % 11 == 0, 2)}
    cols |= {"proxy_available": d % 4 != 1, "coverage": F.when(d % 9 != 0, (d % 10) / 10.0), "ext": F.when(d % 2 == 0, ".pdf").otherwise(".doc"), "source_pages": d % 5, "page_coverage": (d % 7) / 6.0}
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", *[v.alias(k) for k, v in cols.items()])


def attribution(spark, sf_dir) -> DataFrame:
    """SCAL-S17: types and codes of the outputs' problems, in order."""
    codes = F.array_join(F.transform(matching.attributed(), lambda x: F.concat_ws(":", x["type"], x["code"])), ",")
    return outputs(spark, sf_dir).select("doc_id", codes.alias("problems"), F.array_join(matching.signals(), ",").alias("signals"))


def manifest(spark, sf_dir) -> DataFrame:
    """PRJ-07 and AGG-15: the source manifest, with what shares each content."""
    d = F.col("doc_id").cast("string")
    o = outputs(spark, sf_dir).select(F.concat(F.lit("Doc"), d).alias("document_key"), F.col("lang").alias("category"), F.concat(d, "ext").alias("filename"), F.col("ext").alias("extension"), F.concat_ws("/", "source", d).alias("source_path"), F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("size_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.to_json(F.struct("source_pages")).alias("preflight"), F.array(F.lit("format")).alias("scenarios"))
    return matching.source_manifest(o).select("document_key", "document_id", "unique_source_id", "filename", "source_path", "size_bytes", "duplicate_occurrence_count", F.array_join("duplicate_categories", ",").alias("categories"), F.array_join("duplicate_document_keys", ",").alias("keys"), "preflight")


def numeric(spark, sf_dir) -> DataFrame:
    """AGG-09: count, extremes, interpolated quartiles and mean by flag."""
    return audit.numeric_summary(table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_linenumber") != 5, F.col("l_quantity"))), "v", "l_returnflag", "l_linestatus")


def reading_order(spark, sf_dir) -> DataFrame:
    """WIN-01 and SORT-01: reading order, no order first."""
    f = text_facts(spark, sf_dir)
    return structure.ordered(last_blocks(f.blocks, page_number="page_number").withColumn("order_index", F.when(F.col("page_number") % 2 == 0, F.col("page_number")))).groupBy("doc_id").agg(F.max("rn").cast("long").alias("blocks"), F.count_if(F.col("order_index").isNull() & (F.col("rn") <= 2)).alias("unordered_first"))


QUERIES = {
    "tbl_010_evidence": evidence, "tbl_003_empty_tables": empty_tables, "tbl_009_representation": representation, "tbl_008_drift": drift, "prov_003_artifacts": artifacts, "asset_002_local_references": local_assets, "rpr_002_separators": separators,
    "join_06_relations": relation_closure, "join_11_sheets": sheets, "join_12_positions": positions, "join_17_ordinals": ordinals, "join_13_manifests": manifests, "join_16_asset_blocks": asset_blocks, "agg_01_duplicates": block_duplicates, "agg_06_review": review,
    "agg_07_replay_rollup": replay_rollup, "agg_16_corpus_summary": corpus_summary, "agg_22_implied_size": implied_size, "val_03_contracts": contracts, "scal_s25_maps": option_maps, "scal_s17_attribution": attribution, "prj_07_source_manifest": manifest, "agg_09_numeric_summary": numeric, "win_01_reading_order": reading_order,
}
_P = ["".join((t, ":", c)) for t, c in matching.PROBLEMS]
ATTRIBUTION_SQL = f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS t, doc_id % 7 <> 0 AS ok FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT ok THEN '{_P[0]}' END, CASE WHEN ok AND t < 100 THEN '{_P[1]}' END, CASE WHEN ok AND doc_id % 2 > 0 AND doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN '{_P[2]}' END, CASE WHEN ok AND doc_id % 4 > 0 AND doc_id % 3 = 0 THEN '{_P[3]}' END, CASE WHEN ok AND doc_id % 6 = 0 AND doc_id % 4 <> 0 THEN '{_P[4]}' END,
  CASE WHEN ok AND t % 3 > 0 THEN '{_P[5]}' END, CASE WHEN ok AND doc_id % 11 = 0 THEN '{_P[6]}' END], lambda v: v IS NOT NULL), ',') AS problems,
  concat_ws(',', CASE WHEN doc_id % 4 <> 1 AND doc_id % 9 <> 0 AND doc_id % 10 < 5 AND t >= 100 THEN '{matching.SIGNALS[0]}' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 > 1 AND doc_id % 7 < 5 THEN '{matching.SIGNALS[1]}' END) AS signals FROM d"""
MANIFEST_SQL = """WITH d AS (SELECT *, coalesce(text, '') AS t, CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.doc' END AS ext FROM documents), g AS (SELECT t, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories, string_agg(DISTINCT 'Doc' || doc_id, ',' ORDER BY 'Doc' || doc_id) AS keys FROM d GROUP BY t)
SELECT 'Doc' || doc_id AS document_key, substr(sha256('Doc' || doc_id), 1, 16) AS document_id, substr(sha256(t), 1, 16) AS unique_source_id, doc_id || ext AS filename, source || '/' || doc_id AS source_path, octet_length(encode(t))::INT AS size_bytes, n AS duplicate_occurrence_count, categories, keys, '{"source_pages":' || (doc_id % 5) || '}' AS preflight FROM d JOIN g USING (t)"""
ORACLES = {
    "tbl_010_evidence": EVIDENCE_SQL, "tbl_009_representation": REPRESENTATION_SQL, "prov_003_artifacts": ARTIFACT_SQL, "join_11_sheets": SHEET_SQL, "agg_01_duplicates": DUPLICATE_SQL,
    "tbl_003_empty_tables": "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS block_id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND (o_orderkey % 16 = 0 OR o_orderkey % 10 <> 0))",
    "asset_002_local_references": "SELECT page_id::VARCHAR AS doc_id, '' AS state, 'warning|' || CASE WHEN page_id % 3 = 0 THEN '1 image links lack an asset: y.png' ELSE '2 image links lack an asset: x\\' || page_id || '.png y.png' END || '|0' AS issues FROM pages",
    "rpr_002_separators": "SELECT p_partkey, '| a | b | c |' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '|:-|---|---|' WHEN 1 THEN '|:-|:-|---|' ELSE '|:-|:-|:-|' END || chr(10) || '| ' || p_name || ' |' AS md FROM part",
    "join_06_relations": f"WITH {TREE_SQL} SELECT r.doc_id, from_id, to_id FROM rel r JOIN heads a ON a.block_id = from_id JOIN heads b ON b.block_id = to_id WHERE a.order_index % 4 <> 3 AND b.order_index % 4 <> 3",
    "join_12_positions": "WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, l_linenumber AS source_row FROM lineitem), c AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS row FROM lineitem) SELECT c.l_orderkey, c.row, source_row FROM c LEFT JOIN s ON s.l_orderkey = c.l_orderkey AND s.pos = c.row",
    "join_17_ordinals": "WITH a AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS d, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS other, o_orderdate AS d2, o_totalprice AS p2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus <> 'O') SELECT k, o_orderkey, other, d = d2 AND p = p2 AS equal FROM a JOIN b USING (k, i, n)",
    "win_01_reading_order": f"WITH {TEXT_SQL}, b AS (SELECT doc_id, block_id, arg_max(page_number, coalesce(order_index, -1) * 1000000000 + page_number) AS p FROM blocks GROUP BY doc_id, block_id), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN p % 2 = 0 THEN p ELSE -1 END, block_id) AS rn FROM b) SELECT doc_id, max(rn) AS blocks, count(*) FILTER (p % 2 <> 0 AND rn <= 2) AS unordered_first FROM o GROUP BY doc_id",
    "tbl_008_drift": DRIFT_SQL,
    "join_13_manifests": "WITH m AS (SELECT lower(p_name) AS key, arg_max(p_brand, p_partkey) AS status FROM part WHERE p_partkey % 3 <> 0 GROUP BY lower(p_name)) SELECT p_partkey, coalesce(status, 'unparsed') AS status FROM part LEFT JOIN m ON lower(p_name) = key",
    "join_16_asset_blocks": "WITH d AS (SELECT DISTINCT l_partkey AS p_partkey, l_orderkey FROM lineitem), g AS (SELECT p_partkey, array_to_string(list(l_orderkey ORDER BY l_orderkey), ',') AS blocks, count(*) AS n FROM d GROUP BY p_partkey) SELECT p_partkey, coalesce(blocks, '') AS blocks, coalesce(n, 0) AS n FROM part LEFT JOIN g USING (p_partkey)",
    "agg_06_review": f"WITH e AS ({EVIDENCE_SQL}) SELECT doc_id, 'table' AS scope, sum(n)::BIGINT AS n, sum(n)::BIGINT AS manual FROM e GROUP BY doc_id",
    "agg_07_replay_rollup": "SELECT source, sum(n)::BIGINT AS docs, string_agg(lang || '=' || n, ';' ORDER BY lang || '=' || n) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "agg_16_corpus_summary": "SELECT lang, count(*) AS docs, sum(length(coalesce(text, '')))::BIGINT AS chars, count(DISTINCT sha256(coalesce(text, ''))) AS different, count(*) FILTER (length(coalesce(text, '')) < 100) AS short FROM documents GROUP BY ROLLUP (lang)",
    "agg_22_implied_size": f"WITH {TABLE_SQL} SELECT table_id, CASE WHEN n = 0 THEN 0 ELSE n + 1 END::BIGINT AS n_rows, CASE WHEN n = 0 THEN 0 ELSE 4 END::BIGINT AS n_cols FROM tabs WHERE num_rows IS NULL",
    "val_03_contracts": "SELECT array_to_string(list_filter([CASE WHEN l_linenumber <> 2 AND (l_extendedprice / 90 > 1000 OR l_extendedprice < 0) THEN 'bbox' END, CASE WHEN l_tax * 15 > 1 THEN 'confidence' END, CASE WHEN l_linenumber - 2 < 1 THEN 'page' END, CASE WHEN l_partkey % 4 = 0 THEN 'path' END, CASE WHEN l_partkey % 3 = 0 THEN 'sha256' END], lambda v: v IS NOT NULL), ',') AS errors, count(*) AS n FROM lineitem GROUP BY 1",
    "scal_s25_maps": "SELECT p_partkey, 'a=' || p_partkey || ',b=y' AS filled, CASE WHEN p_partkey % 2 = 0 THEN 'is_ocr=' || (p_partkey % 3 = 1 OR p_partkey % 10 >= 5)::VARCHAR || ',language=' || CASE WHEN p_partkey % 5 = 0 THEN 'ch' ELSE 'auto' END ELSE 'do_ocr=' || (p_partkey % 3 = 1 OR p_partkey % 10 >= 5)::VARCHAR END AS options FROM part",
    "scal_s17_attribution": ATTRIBUTION_SQL, "prj_07_source_manifest": MANIFEST_SQL,
    "agg_09_numeric_summary": "WITH v AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber <> 5 THEN l_quantity END AS v FROM lineitem) SELECT l_returnflag, l_linestatus, count(v) AS n, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max, round(avg(v), 6) AS mean FROM v GROUP BY ALL",
}


def invariants(spark, sf_dir) -> DataFrame:
    """VAL-03: which invariants of routing, capabilities, boxes, pictures, slots and reports orders break."""
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    cols = {
        "routing": ({"mode": pick("manual", "automatic"), "requested": pick("a", "b", None), "selected": pick("a", "c", "b", "a"), "allow_fallback": k % 5 == 0, "fallbacks": F.array(pick("a", "x", "y"), F.lit("x"))}, validation.routing_errors),
        "capability": ({"state": pick("available", "partial", "failed"), "reason": pick("", "why", None, "x")}, validation.capability_errors),
        "box": ({"bbox": F.when(k % 7 != 0, F.array((k % 11).cast("double"), F.lit(0.0), F.lit(5.0), (k % 1300).cast("double"))), "coordinate_system": pick("normalized_1000", "pixels"), "origin": pick(None, "top_left", "bottom_left")}, validation.thousandth_errors),
        "visual": ({"status": pick("ready", "skipped", "error", "missing", "pending"), "provenance": pick("p", None), "searchable": k % 3 == 0, "reason": pick(None, "r", ""), "error": pick("e", None, None)}, validation.visual_errors),
        "slot": ({"kind": pick("origin", "covered", "empty"), "cell_id": pick("c", None), "origin_cell_id": pick("", "o", None, "o")}, validation.slot_errors),
        "report": ({"state": pick("pass", "reparse_required", "rejected"), "recommendation": pick("parser", None), "critical_false_pass": k % 5 == 1, "document_id": pick("d", "e"), "canonical_id": pick("d", "e", "d"), "report_id": pick("d", "e")}, validation.report_errors),
    }
    o = table(spark, sf_dir, "orders").select(k)
    out = None
    for name, (fields, errors) in cols.items():
        e = o.select(k, *[v.alias(c) for c, v in fields.items()]).select(F.lit(name).alias("record"), k, F.explode(errors()).alias("code"))
        out = e if out is None else out.unionByName(e)
    return out


def _pick(*v) -> str:
    return f"([{', '.join('NULL' if x is None else repr(x) for x in v)}])[k % {len(v)} + 1]"


INVARIANT_SQL = f"""WITH o AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k, {_pick('manual', 'automatic')} = 'manual' AS m, {_pick('a', 'b', None)} AS req, {_pick('a', 'c', 'b', 'a')} AS sel, {_pick('a', 'x', 'y')} AS fb FROM o),
b AS (SELECT k, (k % 11)::DOUBLE AS x0, (k % 1300)::DOUBLE AS y1, k % 2 = 0 AND k % 7 <> 0 AS own FROM o), v AS (SELECT k, {_pick('ready', 'skipped', 'error', 'missing', 'pending')} AS st FROM o)
SELECT 'routing' AS record, k AS o_orderkey, unnest(list_filter([CASE WHEN m AND req IS NULL THEN 'manual_without_choice' END, CASE WHEN m AND req <> sel THEN 'manual_not_followed' END, CASE WHEN m AND k % 5 = 0 THEN 'manual_with_fallback' END, CASE WHEN sel = fb THEN 'selected_as_fallback' END, CASE WHEN fb = 'x' THEN 'repeated_fallback' END], lambda c: c IS NOT NULL)) AS code FROM r
UNION ALL SELECT 'capability', k, 'missing_reason' FROM o WHERE k % 3 > 0 AND k % 4 IN (0, 2)
UNION ALL SELECT 'box', k, unnest(list_filter([CASE WHEN own AND y1 > 1000 THEN 'out_of_range' END, CASE WHEN own AND x0 > 5 THEN 'wrong_order' END, CASE WHEN own AND k % 3 = 2 THEN 'wrong_origin' END], lambda c: c IS NOT NULL)) FROM b
UNION ALL SELECT 'visual', k, unnest(list_filter([CASE WHEN st = 'ready' AND k % 2 = 1 THEN 'ready_without_provenance' END, CASE WHEN st <> 'ready' AND k % 3 = 0 THEN 'searchable_too_early' END, CASE WHEN st IN ('skipped', 'missing') AND k % 3 <> 1 THEN 'missing_reason' END, CASE WHEN st = 'error' AND k % 3 > 0 THEN 'missing_error' END], lambda c: c IS NOT NULL)) FROM v
UNION ALL SELECT 'slot', k, CASE WHEN k % 3 = 0 THEN 'origin_without_cell' ELSE 'covered_without_origin' END FROM o WHERE (k % 3 = 0 AND k % 2 = 1) OR (k % 3 = 1 AND k % 4 IN (0, 2))
UNION ALL SELECT 'report', k, unnest(list_filter([CASE WHEN k % 3 = 1 AND k % 2 = 1 THEN 'reparse_without_recommendation' END, CASE WHEN k % 5 = 1 AND k % 3 = 0 THEN 'false_pass' END, CASE WHEN (k % 2 = 0) <> (k % 3 <> 1) THEN 'other_document' END], lambda c: c IS NOT NULL)) FROM o"""
QUERIES["val_03_invariants"] = invariants
ORACLES["val_03_invariants"] = INVARIANT_SQL
