"""Corpus analytics, joins, set operations, windows, ranking and scalars, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions import exprs as x
from lithoframe.operators import audit, content, tables
from lithoframe.plans.rules import TEXT_SQL
from lithoframe.sources.lift import TABLE_SQL, table, table_facts, text_facts

EXTS = (".pdf", ".docx", ".xls", ".pptx", ".doc", ".xlsx", ".ppt")


def records(spark, sf_dir) -> DataFrame:
    """documents as audit records: extension, page count, flags from the key; issues from the text."""
    d = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (d % 7 + 1).cast("int"))
    tags = audit.scenarios(ext, (d % 11) / 10.0, d % 8, d % 4, d % 130, d % 300, d % 6 == 0, d % 9 == 0, d % 10 == 0, d % 12, F.length(t) >= 10_000, F.when(d % 29 == 0, 2), F.when(d % 31 == 0, audit.IMAGE_CATEGORY), F.array((d % 5).cast("int"), (d % 6).cast("int"), F.lit(None).cast("int")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("Doc"), d.cast("string")).alias("document_key"), F.sha2(t, 256).alias("unique_source"), ext.alias("ext"), tags.alias("scenarios"), (F.length(t) % 9).cast("int").alias("issues"), F.col("source").alias("model"), F.length(t).alias("chars"), d.alias("doc_id"))


_L = lambda v: "[" + ", ".join(f"'{a}'" for a in v) + "]"
RECORD_SQL = f"""r AS (SELECT 'Doc' || doc_id AS document_key, sha256(coalesce(text, '')) AS unique_source, {_L(EXTS)}[doc_id % 7 + 1] AS ext, length(coalesce(text, '')) % 9 AS issues, source AS model, length(coalesce(text, '')) AS chars, doc_id FROM documents),
rs AS (SELECT *, list_sort(list_filter(['format_' || ext[2:], CASE WHEN ext = '.pdf' THEN CASE WHEN doc_id % 11 >= 8 THEN 'scanned_ocr_pdf' WHEN doc_id % 11 <= 2 THEN 'ordinary_text_pdf' ELSE 'mixed_text_scan_pdf' END END, CASE WHEN doc_id % 8 >= 5 OR doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 'image_rich' END, CASE WHEN doc_id % 4 >= 3 OR doc_id % 130 >= 100 OR (doc_id % 5 >= 3 AND doc_id % 6 >= 3) THEN 'complex_table' END,
  CASE WHEN ext IN ('.doc', '.ppt', '.xls') THEN 'legacy_office' END, CASE WHEN doc_id % 300 >= 200 THEN 'very_long_document' END, CASE WHEN doc_id % 6 = 0 THEN 'split_document' END, CASE WHEN doc_id % 9 = 0 THEN 'parser_failure' END, CASE WHEN doc_id % 10 = 0 THEN 'empty_pseudo_success' END, CASE WHEN doc_id % 12 > 0 THEN 'data_uri' END, CASE WHEN chars >= 10000 THEN 'giant_block' END], lambda v: v IS NOT NULL)) AS scenarios FROM r)"""


def scenario_tags(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.array_join("scenarios", ",").alias("scenarios"))


def scenario_groups(spark, sf_dir) -> DataFrame:
    """AGG-11: counts per format and per scenario in one pass over grouping sets."""
    e = records(spark, sf_dir).withColumn("scenario", F.explode("scenarios"))
    g = e.groupingSets([["ext"], ["scenario"]], "ext", "scenario").agg(F.countDistinct("doc_id").alias("docs"), F.sum("issues").alias("issues"))
    return g.select("ext", "scenario", "docs", "issues")


def model_summary(spark, sf_dir) -> DataFrame:
    """AGG-12 and AGG-09: per model counts, a histogram as text, and the distribution of lengths."""
    r = records(spark, sf_dir)
    s = audit.numeric_summary(r, "chars", "model")
    h = r.groupBy("model", "ext").agg(F.count("*").alias("n")).groupBy("model").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "ext", F.col("n").cast("string")))), ";").alias("formats"))
    return s.join(h, "model")


def duplicate_outputs(spark, sf_dir) -> DataFrame:
    """AGG-13 to AGG-15: equal sources, whether their outputs agree, and the first of each."""
    r = records(spark, sf_dir)
    g = r.groupBy("unique_source").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"), F.min_by("document_key", "doc_id").alias("first_key")).filter("n > 1")
    return r.join(g, "unique_source").select("doc_id", "n", "models", "first_key")


def rating_histogram(spark, sf_dir) -> DataFrame:
    """AGG-17 and SCAL-S18: ratings by model, format and rating with totals (rollup)."""
    d = F.col("doc_id")
    rated = records(spark, sf_dir).withColumn("rating", audit.rating(d % 9 == 0, d % 5 != 0, F.when(d % 4 != 1, (d % 100) / 100.0), 0.8, 0.4))
    return rated.rollup("model", "ext", "rating").agg(F.count("*").alias("n"))


def rated_outputs(spark, sf_dir) -> DataFrame:
    """SCAL-S18: all seven ratings of every record."""
    d = F.col("doc_id")
    r = records(spark, sf_dir).select(
        "doc_id", "ext", "scenarios", F.when(d % 7 != 3, d % 300).cast("int").alias("source_pages"), (d % 9 != 0).alias("parser_success"), (d % 10 == 0).alias("is_empty"), (d % 4 != 1).alias("proxy_available"), ((d % 101) / 100.0).alias("coverage"),
        F.when(d % 6 != 5, (d % 97) / 96.0).alias("order_score"), ((d % 40) / 20.0).alias("length_ratio"), F.when(d % 8 != 7, (d % 51) / 50.0).alias("page_coverage"), (d % 3).alias("table_count"), (d % 5).alias("table_cells"), (d % 2).alias("html_tables"), F.when(d % 3 != 0, d % 4).alias("pipe_rows"),
        (d % 5).alias("references"), (d % 7 - 5).alias("missing_references"), F.lit(0).alias("assets"), (d % 11).alias("pictures"), (d % 4).alias("headings"), F.col("chars").alias("blocks"), "chars",
    )
    return audit.capability_ratings(r).select("doc_id", "ratings.*")


RATED_SQL = f"""WITH {RECORD_SQL}, x AS (SELECT doc_id, ext, chars, doc_id % 9 = 0 OR doc_id % 10 = 0 AS dead, doc_id % 4 <> 1 AS proxy, (doc_id % 101) / 100.0 AS cov, CASE WHEN doc_id % 6 <> 5 THEN (doc_id % 97) / 96.0 END AS ord, (doc_id % 40) / 20.0 AS len, CASE WHEN doc_id % 8 <> 7 THEN (doc_id % 51) / 50.0 END AS pc,
  doc_id % 2 + CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 ELSE 0 END AS md, list_contains(scenarios, 'complex_table') AS tab, list_contains(scenarios, 'image_rich') AS img, list_contains(scenarios, 'scanned_ocr_pdf') AS ocr FROM rs)
SELECT doc_id, CASE WHEN dead THEN 'failed' WHEN NOT proxy THEN 'not_applicable' WHEN cov >= 0.8 AND len BETWEEN 0.6 AND 1.8 THEN 'good' WHEN cov >= 0.3 THEN 'partial' ELSE 'failed' END AS text_fidelity,
  CASE WHEN dead THEN 'failed' WHEN NOT proxy OR ord IS NULL THEN 'not_applicable' WHEN ord >= 0.95 THEN 'good' WHEN ord >= 0.6 THEN 'partial' ELSE 'failed' END AS reading_order,
  CASE WHEN ext <> '.pdf' THEN 'not_applicable' WHEN dead THEN 'failed' WHEN doc_id % 7 = 3 THEN 'not_applicable' WHEN pc >= 0.95 THEN 'good' WHEN pc > 0 THEN 'partial' ELSE 'failed' END AS page_traceability,
  CASE WHEN NOT tab THEN 'not_applicable' WHEN dead THEN 'failed' WHEN doc_id % 5 > 0 AND md > 0 THEN 'good' WHEN doc_id % 3 > 0 OR md > 0 THEN 'partial' ELSE 'failed' END AS table_fidelity,
  CASE WHEN NOT img THEN 'not_applicable' WHEN dead THEN 'failed' WHEN doc_id % 5 > 0 AND doc_id % 7 = 5 THEN 'good' WHEN doc_id % 5 > 0 OR doc_id % 11 > 0 THEN 'partial' ELSE 'failed' END AS image_fidelity,
  CASE WHEN dead THEN 'failed' WHEN doc_id % 4 >= 2 THEN 'good' WHEN chars > 0 THEN 'partial' ELSE 'failed' END AS heading_structure,
  CASE WHEN NOT ocr THEN 'not_applicable' WHEN dead OR chars = 0 THEN 'failed' ELSE 'partial' END AS ocr_quality FROM x"""


def overrides(spark, sf_dir) -> DataFrame:
    """JOIN-15: manual ratings replace automatic ones on a three-part key."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_key"), F.col("source").alias("parser"), F.lit("text").alias("capability"), F.when(F.col("doc_id") % 2 == 0, "good").otherwise("partial").alias("rating"))
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_key"), F.when(F.col("quality") == 1, "good").otherwise("failed").alias("rating"))
    m = m.join(d.select("document_key", "parser", "capability"), "document_key")
    return audit.overridden(d, m)


def best_candidate(spark, sf_dir) -> DataFrame:
    """RANK-01: the best output of each customer's orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    models = F.array(*[F.lit(m) for m in (*audit.MODEL_PRIORITY, "other")])
    r = o.select("o_custkey", k, (k % 5 != 0).alias("usable"), (k % 7 != 0).alias("nonempty"), (k % 3).alias("assets"), (k % 4).alias("critical"), F.concat(F.element_at(models, (k % 5 + 1).cast("int"))).alias("model"), F.col("o_totalprice").cast("long").alias("chars"))
    # one candidate a model and source: the one with the smallest key
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("o_custkey", "model").orderBy("o_orderkey"))).filter("_n = 1").drop("_n")
    return audit.best_candidates(r, "o_custkey").select("o_custkey", "o_orderkey", "model")


BEST_SQL = f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 <> 0 AS usable, o_orderkey % 7 <> 0 AS nonempty, o_orderkey % 3 AS assets, o_orderkey % 4 AS critical, {_L([*audit.MODEL_PRIORITY, 'other'])}[o_orderkey % 5 + 1] AS model, [4, 3, 2, 1, 0][o_orderkey % 5 + 1] AS prio, CAST(trunc(o_totalprice) AS BIGINT) AS chars,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY usable DESC, nonempty DESC, assets > 0 DESC, critical, prio DESC, least(chars, 200000) DESC, model) AS k FROM r WHERE n = 1) SELECT o_custkey, o_orderkey, model FROM s WHERE k = 1"""


def fidelity(spark, sf_dir) -> DataFrame:
    """SCAL-S14 and WIN-07: each document against its own text cut at two thirds."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    p = d.select("doc_id", F.col("t").alias("source_text"), F.substring(F.col("t"), F.lit(1), F.floor(F.length("t") * 2 / 3).cast("int")).alias("output_text"))
    return audit.text_fidelity(p).select("doc_id", "available", "anchors", "matched")


NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
FIDELITY_SQL = f"""WITH n AS (SELECT doc_id, {NORM.format("coalesce(text, '')")} AS s, {NORM.format("substr(coalesce(text, ''), 1, (length(coalesce(text, '')) * 2 // 3)::INT)")} AS o FROM documents),
st AS (SELECT *, greatest(24, length(s) // least(200, greatest(20, length(s) // 500))) AS step FROM n),
a AS (SELECT doc_id, s, o, CASE WHEN length(s) > 0 AND length(o) > 0 THEN list_filter(list_transform(range(0, greatest(length(s) - 24, 0)::BIGINT + 1, step), lambda p: substr(s, p + 1, 24)), lambda t: length(t) >= 12) ELSE [] END AS an FROM st)
SELECT doc_id, length(s) > 0 AS available, CASE WHEN length(s) > 0 THEN len(an) END::BIGINT AS anchors, CASE WHEN length(s) > 0 THEN len(list_filter(an, lambda t: contains(o, t))) END::BIGINT AS matched FROM a"""


def marked_up(spark, sf_dir) -> DataFrame:
    """documents as Markdown: every third line a heading, every fifth a pipe row, links and blank lines between."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda v, i: F.when(i % 3 == 0, F.concat(F.lit("## "), v)).when(i % 5 == 4, F.concat(F.lit("| "), v, F.lit(" |"))).when(i % 7 == 1, F.concat(v, F.lit("\n\n![a](img/"), i.cast("string"), F.lit(".png?x) ![b](https://e.org/b.png)"))).otherwise(v))
    return d.select("doc_id", F.array_join(lines, "\n").alias("markdown"))


MARKED_SQL = "md AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' || v WHEN (i - 1) % 5 = 4 THEN '| ' || v || ' |' WHEN (i - 1) % 7 = 1 THEN v || chr(10) || chr(10) || '![a](img/' || (i - 1) || '.png?x) ![b](https://e.org/b.png)' ELSE v END), chr(10)) AS markdown FROM documents)"


def markdown_metrics(spark, sf_dir) -> DataFrame:
    m = marked_up(spark, sf_dir)
    assets = m.select("doc_id", F.explode(F.array(F.lit("img/1.png"), F.lit("img/8.png"))).alias("path"))
    return audit.markdown_metrics(m, assets).select("doc_id", "chars", "sha256", "headings", "pipe_rows", "html_tables", "image_refs", "external_refs", "missing_refs")


METRIC_SQL = f"""WITH {MARKED_SQL}, refs AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '!\\[[^\\]]*\\]\\(([^\\)]+)\\)', 1)) AS ref FROM md),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ref LIKE 'http%') AS ext, count(*) FILTER (ref NOT LIKE 'http%' AND split_part(ref, '?', 1) NOT IN ('img/1.png', 'img/8.png')) AS miss FROM refs GROUP BY doc_id)
SELECT doc_id, length(markdown)::BIGINT AS chars, sha256(markdown) AS sha256, len(regexp_extract_all(markdown, '(?m)^#{{1,6}}\\s+\\S'))::BIGINT AS headings, len(regexp_extract_all(markdown, '(?m)^[ \\t]*\\|.*\\|[ \\t]*$'))::BIGINT AS pipe_rows, 0::BIGINT AS html_tables, coalesce(n, 0)::BIGINT AS image_refs, coalesce(ext, 0)::BIGINT AS external_refs, coalesce(miss, 0)::BIGINT AS missing_refs FROM md LEFT JOIN r USING (doc_id)"""


def markdown_blocks(spark, sf_dir) -> DataFrame:
    """SRC-31 and WIN-09: Markdown segmented to blocks by running sums."""
    b = audit.markdown_lines(marked_up(spark, sf_dir)).filter("block is not null")
    return b.groupBy("doc_id").agg(F.countDistinct("block").alias("blocks"), F.count("*").alias("lines"))


BLOCKS_SQL = f"""WITH {MARKED_SQL}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS n FROM md),
f AS (SELECT *, line LIKE '#%' AS head, trim(line, ' ' || chr(9) || chr(13)) = '' AS gap FROM l), g AS (SELECT *, lag(head OR gap) OVER (PARTITION BY doc_id ORDER BY n) AS brk FROM f)
SELECT doc_id, count(*) FILTER (head OR coalesce(brk, true)) AS blocks, count(*) AS lines FROM g WHERE NOT gap GROUP BY doc_id"""


def image_references(spark, sf_dir) -> DataFrame:
    """JOIN-03: local image links without an asset."""
    m = marked_up(spark, sf_dir)
    r = content.image_references(m).withColumnRenamed("ref", "path")
    a = m.select("doc_id", F.lit("img/1.png?x").alias("path"))
    return r.join(a, ["doc_id", "path"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


def unpaired_tables(spark, sf_dir) -> DataFrame:
    """JOIN-02: table blocks without a table (tables here: every other order)."""
    f = table_facts(spark, sf_dir)
    have = f.tables.filter(F.col("table_id").cast("long") % 2 == 0)
    return f.blocks.filter("kind = 'table'").join(have, ["doc_id", "block_id"], "left_anti").select("doc_id", "block_id")


def span_slots(spark, sf_dir) -> DataFrame:
    """JOIN-08: which cell covers each slot, by exploded spans and an equi-join."""
    f = table_facts(spark, sf_dir)
    return tables.slots(f.cells).groupBy("doc_id", "table_id").agg(F.count("*").alias("slots"), F.countDistinct("r", "c").alias("distinct_slots"), F.max("c").cast("long").alias("last_col"))


SLOT_SQL = f"WITH {TABLE_SQL}, s AS (SELECT k, 0 AS r, unnest(range(start_col, start_col + col_span)) AS c FROM head UNION ALL SELECT k, start_row, start_col FROM body UNION ALL SELECT k, start_row, start_col FROM body WHERE k % 9 = 0 AND start_row = 1 AND start_col = 1) SELECT doc_id, table_id, count(*) AS slots, count(DISTINCT (r, c)) AS distinct_slots, max(c)::BIGINT AS last_col FROM s JOIN tabs USING (k) GROUP BY doc_id, table_id"


def row_headers(spark, sf_dir) -> DataFrame:
    """AGG-21: row keys of valid tables that repeat."""
    f = table_facts(spark, sf_dir)
    r = tables.row_keys(tables.analysis(f), f.cells, f.buckets)
    return r.filter("repeated").groupBy("doc_id", "table_id", "row_key").agg(F.count("*").alias("n"))


def anchors(spark, sf_dir) -> DataFrame:
    """SCAL-S10: regions as grids of nations, rendered with covered slots repeating their origin."""
    n = table(spark, sf_dir, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    d, t = F.col("n_regionkey").cast("string").alias("doc_id"), F.lit("t").alias("table_id")
    cells = n.select(d, t, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("cell_id"), F.col("i").alias("start_row"), F.lit(0).alias("start_col"), F.concat("n_name", F.lit("|"), F.lit("x\ny")).alias("text"))
    grid = n.select(d, t, F.col("i").alias("r"), F.explode(F.array(F.lit(0), F.lit(1))).alias("c"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("cell_id"))
    return tables.anchor_copy(grid, cells).select("doc_id", "rendered")


ANCHOR_SQL = r"""WITH n AS (SELECT n_regionkey::VARCHAR AS doc_id, n_name || '\|x<br>y' AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT doc_id, string_agg('| ' || t || ' | ' || t || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS rendered FROM n GROUP BY doc_id"""


def set_operations(spark, sf_dir) -> DataFrame:
    """SET-02, SET-04 and SET-07: expected and actual keys in both directions."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def ordered_distinct(spark, sf_dir) -> DataFrame:
    """SET-06 and TOPK-01: first occurrences in order, and sorted samples of at most 50."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(w), " ").alias("first_words"), F.array_join(F.slice(F.array_sort(F.array_distinct(w)), 1, 50), " ").alias("sample"))


def contiguous_pages(spark, sf_dir) -> DataFrame:
    """WIN-08: whether a conversation's turns follow each other without a gap."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").filter(F.col("conv_id") % 9 != F.col("turn"))
    return c.withColumn("ok", F.coalesce(F.lag("turn").over(w) + 1 == F.col("turn"), F.lit(True))).groupBy("conv_id").agg(F.bool_and("ok").alias("contiguous"))


def coverage(spark, sf_dir) -> DataFrame:
    """AGG-19: shares of blocks with page, box and source id."""
    return audit.coverage(text_facts(spark, sf_dir).blocks, "doc_id")


def totals(spark, sf_dir) -> DataFrame:
    """AGG-10: totals of nullable columns, null as zero."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.coalesce(F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("long")), F.lit(0))).alias("quantity"), F.count("*").alias("n"))


def combinations(spark, sf_dir) -> DataFrame:
    """AGG-18, SCAL-S20 and TOPK-03: status of four parsers per source, their combination, most common first."""
    status = F.when(F.col("l_quantity") > 25, "ok").otherwise("empty")
    p = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3, 4]).agg(F.max(status))
    cols = [F.coalesce(F.col(str(i)), F.lit("missing")) for i in (1, 2, 3, 4)]
    p = p.select(F.concat_ws("/", *cols).alias("combination"), (F.size(F.array_distinct(F.array(*cols))) > 1).alias("differs"), sum([(c == "ok").cast("int") for c in cols], F.lit(0)).alias("successes"))
    return p.groupBy("combination", "differs", "successes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination")


_STATUS = "coalesce(max(CASE WHEN l_quantity > 25 THEN 'ok' ELSE 'empty' END) FILTER (l_linenumber = {}), 'missing') AS {}"
COMBINATION_SQL = f"WITH p AS (SELECT l_orderkey, {', '.join(_STATUS.format(i + 1, c) for i, c in enumerate('abcd'))} FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey) SELECT a || '/' || b || '/' || c || '/' || d AS combination, NOT (a = b AND b = c AND c = d) AS differs, (a = 'ok')::INT + (b = 'ok')::INT + (c = 'ok')::INT + (d = 'ok')::INT AS successes, count(*) AS n FROM p GROUP BY ALL"


def scalars(spark, sf_dir) -> DataFrame:
    """Scalar functions over parts and suppliers."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("C:\\Data/"), "p_name", F.lit(".DOCX. "))
    box = F.array((k % 50).cast("double"), F.lit(10.0), (k % 90).cast("double"), (k % 20).cast("double"))
    number = F.concat((k % 12).cast("string"), F.when(k % 3 == 0, ".1").when(k % 3 == 1, ".2.3").otherwise(""), F.lit(" Title"))
    return p.select("p_partkey", x.window_name(name).alias("file"), x.file_extension("p_name").alias("ext"), x.column_letters((k % 18000).cast("int")).alias("letters"), x.a1((k % 9).cast("int"), (k % 800).cast("int")).alias("a1"), x.bbox_valid(box, F.lit("TopLeft")).alias("box_ok"), F.array_join(F.transform(x.bbox_thousandths(box, F.lit(100.0), F.lit(50.0), F.lit("bottom-left")), lambda v: v.cast("int").cast("string")), ",").alias("box"), x.numbered_level(number).cast("long").alias("level"), x.escape_cell(F.concat("p_name", F.lit("|\r\nz"))).alias("cell"), F.array_join(x.expand_marker(F.concat((k % 9).cast("string"), F.lit(", 3-"), (k % 7).cast("string"))), ",").alias("labels"), x.is_sha256(F.when(k % 2 == 0, F.sha2("p_name", 256)).otherwise(F.col("p_name"))).alias("sha"), x.safe_path(F.when(k % 3 == 0, F.concat(F.lit("a/../"), "p_name")).otherwise(F.concat(F.lit("a/"), "p_name"))).alias("safe"))


SCALAR_SQL = r"""WITH p AS (SELECT *, p_partkey AS k, (p_partkey % 18000)::INT AS i, (p_partkey % 800)::INT AS j FROM part),
l AS (SELECT k, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + (i - 26) % 26) ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + (i - 702) % 26) END AS letters, CASE WHEN j < 26 THEN chr(65 + j) WHEN j < 702 THEN chr(65 + (j - 26) // 26) || chr(65 + (j - 26) % 26) ELSE chr(65 + (j - 702) // 676) || chr(65 + (j - 702) // 26 % 26) || chr(65 + (j - 702) % 26) END AS jl FROM p)
SELECT p_partkey, lower(p_name) || '.docx' AS file, '' AS ext, letters, jl || (k % 9 + 1) AS a1, (k % 90 > k % 50 AND k % 20 > 10) AS box_ok, ((k % 50) * 10)::INT || ',' || 800 || ',' || ((k % 90) * 10)::INT || ',' || trunc((50.0 - k % 20) / 50.0 * 1000)::INT AS box,
  CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END::BIGINT AS level, p_name || '\|<br>z' AS cell, CASE WHEN k % 7 >= 3 THEN array_to_string(CASE WHEN k % 9 BETWEEN 3 AND k % 7 THEN [k % 9] || list_filter(range(3, k % 7 + 1), lambda v: v <> k % 9) ELSE [k % 9] || range(3, k % 7 + 1) END, ',') END AS labels, k % 2 = 0 AS sha, k % 3 <> 0 AS safe FROM p JOIN l USING (k)"""


def stable_ids(spark, sf_dir) -> DataFrame:
    """Identity rules: version 5 ids of customers."""
    return table(spark, sf_dir, "customer").select("c_custkey", x.uuid5(F.concat_ws("|", F.lit("block"), "c_name", F.col("c_custkey").cast("string"))).alias("id"))


def samples(spark, sf_dir) -> DataFrame:
    """TOPK-02: the stratified audit sample (bounded by its definition)."""
    return audit.select_samples(records(spark, sf_dir)).select("document_key", F.array_join("reasons", ",").alias("reasons"))


def full_text_search(spark, sf_dir) -> DataFrame:
    """SCAL-S13: token inverted index of cell texts, looked up by two words."""
    f = table_facts(spark, sf_dir)
    idx = f.cells.select("doc_id", "table_id", "cell_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9]+"))).alias("token"))
    both = idx.filter(F.col("token").isin("line", "3")).groupBy("doc_id", "table_id", "cell_id").agg(F.countDistinct("token").alias("k")).filter("k = 2")
    return both.select("doc_id", "table_id", "cell_id")


QUERIES = {
    "scal_s16_scenarios": scenario_tags, "scal_s18_capability_ratings": rated_outputs, "agg_11_group_summary": scenario_groups, "agg_12_model_summary": model_summary, "agg_13_duplicate_outputs": duplicate_outputs, "agg_17_rating_histogram": rating_histogram,
    "join_15_manual_override": overrides, "rank_01_best_candidate": best_candidate, "scal_s14_text_fidelity": fidelity, "agg_08_markdown_metrics": markdown_metrics, "src_31_markdown_blocks": markdown_blocks,
    "join_03_missing_assets": image_references, "join_02_unpaired_tables": unpaired_tables, "join_08_span_slots": span_slots, "agg_21_row_keys": row_headers, "scal_s10_anchor_copy": anchors,
    "set_04_key_differences": set_operations, "set_06_ordered_distinct": ordered_distinct, "win_08_contiguity": contiguous_pages, "agg_19_coverage": coverage, "agg_10_totals": totals, "agg_18_combinations": combinations,
    "scalar_functions": scalars, "scal_s21_stable_ids": stable_ids, "topk_02_samples": samples, "scal_s13_search": full_text_search,
}
ORACLES = {
    "scal_s18_capability_ratings": RATED_SQL,
    "scal_s21_stable_ids": f"WITH h AS (SELECT c_custkey, sha1(unhex('{x.QUALITY_NAMESPACE}') || encode('block|' || c_name || '|' || c_custkey)) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id FROM h",
    "scal_s16_scenarios": f"WITH {RECORD_SQL} SELECT doc_id, array_to_string(scenarios, ',') AS scenarios FROM rs",
    "agg_11_group_summary": f"WITH {RECORD_SQL}, e AS (SELECT doc_id, ext, issues, unnest(scenarios) AS scenario FROM rs) SELECT ext, scenario, count(DISTINCT doc_id) AS docs, sum(issues)::BIGINT AS issues FROM e GROUP BY GROUPING SETS ((ext), (scenario))",
    "agg_12_model_summary": f"WITH {RECORD_SQL}, q AS (SELECT model, count(chars) AS n, min(chars)::DOUBLE AS min, quantile_cont(chars::DOUBLE, [0.25, 0.5, 0.75]) AS qs, max(chars)::DOUBLE AS max, round(avg(chars), 6) AS mean FROM r GROUP BY model), h AS (SELECT model, string_agg(ext || '=' || c, ';' ORDER BY ext || '=' || c) AS formats FROM (SELECT model, ext, count(*) AS c FROM r GROUP BY ALL) GROUP BY model) SELECT model, n, min, round(qs[1], 6) AS p25, round(qs[2], 6) AS median, round(qs[3], 6) AS p75, max, mean, formats FROM q JOIN h USING (model)",
    "agg_13_duplicate_outputs": f"WITH {RECORD_SQL}, g AS (SELECT unique_source, count(*) AS n, count(DISTINCT model) AS models, arg_min(document_key, doc_id) AS first_key FROM r GROUP BY unique_source HAVING count(*) > 1) SELECT doc_id, n, models, first_key FROM r JOIN g USING (unique_source)",
    "agg_17_rating_histogram": f"WITH {RECORD_SQL}, x AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'not_applicable' WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 4 = 1 THEN 'not_applicable' WHEN doc_id % 100 >= 80 THEN 'good' WHEN doc_id % 100 >= 40 THEN 'partial' ELSE 'failed' END AS rating FROM r) SELECT model, ext, rating, count(*) AS n FROM x GROUP BY ROLLUP (model, ext, rating)",
    "join_15_manual_override": "SELECT d.doc_id::VARCHAR AS document_key, source AS parser, 'text' AS capability, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'good' ELSE 'failed' END WHEN d.doc_id % 2 = 0 THEN 'good' ELSE 'partial' END AS rating, CASE WHEN l.doc_id IS NOT NULL THEN 'manual_source_comparison' ELSE 'evidence_triage' END AS method FROM documents d LEFT JOIN labels l USING (doc_id)",
    "rank_01_best_candidate": BEST_SQL, "scal_s14_text_fidelity": FIDELITY_SQL, "agg_08_markdown_metrics": METRIC_SQL, "src_31_markdown_blocks": BLOCKS_SQL,
    "join_03_missing_assets": f"WITH {MARKED_SQL}, r AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1)) AS ref FROM md) SELECT doc_id, count(*) AS n FROM r WHERE ref NOT LIKE 'http%' AND ref <> 'img/1.png?x' GROUP BY doc_id",
    "join_02_unpaired_tables": "SELECT o_custkey::VARCHAR AS doc_id, 'b' || o_orderkey AS block_id FROM orders WHERE o_orderkey % 2 <> 0",
    "join_08_span_slots": SLOT_SQL,
    "agg_21_row_keys": f"WITH {TABLE_SQL} SELECT doc_id, table_id, text AS row_key, count(*) AS n FROM tabs JOIN body USING (k) WHERE tabs.n > 0 AND k % 9 <> 0 AND k % 7 <> 0 AND start_col = 0 GROUP BY ALL HAVING count(*) > 1",
    "scal_s10_anchor_copy": ANCHOR_SQL,
    "set_04_key_differences": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey * 2 AS k FROM customer) SELECT k, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "set_06_ordered_distinct": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS t, unnest(range(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')))) AS i FROM documents), u AS (SELECT doc_id, t, min(i) AS i FROM w GROUP BY ALL), a AS (SELECT doc_id, list(t ORDER BY i) AS f, list(t ORDER BY t)[1:50] AS s FROM u GROUP BY doc_id) SELECT doc_id, coalesce(array_to_string(f, ' '), '') AS first_words, coalesce(array_to_string(s, ' '), '') AS sample FROM documents LEFT JOIN a USING (doc_id)",
    "win_08_contiguity": "WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE conv_id % 9 <> turn) SELECT conv_id, bool_and(coalesce(p + 1 = turn, true)) AS contiguous FROM c GROUP BY conv_id",
    "agg_19_coverage": f"WITH {TEXT_SQL} SELECT doc_id, count(*) AS n, count(DISTINCT page_number) AS pages, 1.0::DOUBLE AS page_share, round(avg((bbox IS NOT NULL)::INT), 6) AS box_share, round(avg((source_block_id IS NOT NULL)::INT), 6) AS source_share FROM blocks GROUP BY doc_id",
    "agg_10_totals": "SELECT l_returnflag, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_18_combinations": COMBINATION_SQL,
    "scalar_functions": SCALAR_SQL,
    "scal_s13_search": f"WITH {TABLE_SQL} SELECT doc_id, table_id, table_id || ':' || start_row || '.0' AS cell_id FROM tabs JOIN body USING (k) WHERE text = 'line 3'",
}

_QUOTA = sum(n for _, n in audit.BUCKETS)
#: buckets take their quota, the most troubled contents fill up to 28, formats and many reasons first among 32
ORACLES["topk_02_samples"] = f"""WITH {RECORD_SQL}, b AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}', {n})" for i, (s, n) in enumerate(audit.BUCKETS))}) v(bucket, scenario, quota)),
x AS (SELECT document_key, unique_source, len(scenarios) AS many, issues, unnest(scenarios) AS scenario FROM rs),
e AS (SELECT document_key, unique_source, bucket, scenario, row_number() OVER (PARTITION BY bucket ORDER BY many DESC, issues DESC, lower(document_key)) AS rank, quota FROM x JOIN b USING (scenario) QUALIFY rank <= quota),
o AS (SELECT document_key, unique_source, issues, len(scenarios) AS many FROM rs QUALIFY row_number() OVER (PARTITION BY unique_source ORDER BY issues DESC, len(scenarios) DESC, lower(document_key)) = 1),
f AS (SELECT document_key, unique_source, {len(audit.BUCKETS)} AS bucket, 'fill' AS scenario, row_number() OVER (ORDER BY issues DESC, many DESC, lower(document_key)) AS rank FROM o QUALIFY rank <= {28 + _QUOTA}),
u AS (SELECT document_key, unique_source, bucket, scenario, rank FROM e UNION ALL SELECT * FROM f),
k AS (SELECT unique_source, bucket, scenario, first_value(document_key) OVER w AS key, first_value(bucket) OVER w AS fb, first_value(rank) OVER w AS fr FROM u WINDOW w AS (PARTITION BY unique_source ORDER BY bucket, rank)),
g AS (SELECT key, fb, fr, coalesce(list_sort(list(DISTINCT scenario) FILTER (bucket < {len(audit.BUCKETS)})), []) AS reasons FROM k GROUP BY unique_source, key, fb, fr),
n AS (SELECT key, CASE WHEN fb = {len(audit.BUCKETS)} THEN ['anomaly_diversity_fill'] ELSE reasons END AS reasons, fb, row_number() OVER (ORDER BY fb, fr) AS n FROM g)
SELECT key AS document_key, array_to_string(reasons, ',') AS reasons FROM n WHERE fb < {len(audit.BUCKETS)} OR n <= 28 ORDER BY len(list_filter(reasons, lambda r: r LIKE 'format%')) > 0 DESC, len(reasons) DESC, lower(key) LIMIT 32"""
