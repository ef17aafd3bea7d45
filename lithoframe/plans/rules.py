"""Rule queries over lifted facts, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.operators import content, gate, structure, tables
from lithoframe.operators.model import Facts, Result
from lithoframe.sources.lift import CITATION_SQL, HEADING_SQL, TABLE_SQL, TEXT_SQL, citation_facts, heading_facts, table_facts, text_facts


def digest(f: Facts, r: Result) -> DataFrame:
    """(doc_id, state, issues): a rule's verdict on every document and its issues as sorted text."""
    i = r.issues.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "severity", "message", F.size("blocks").cast("string")))), ";").alias("issues"))
    d = f.documents.select("doc_id").join(i, "doc_id", "left")
    d = d.join(r.observations.select("doc_id", "state"), "doc_id", "left") if r.observations is not None else d.withColumn("state", F.lit(None).cast("string"))
    return d.select("doc_id", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("issues", F.lit("")).alias("issues"))


def digest_sql(lift: str, docs: str, issues: str, state: str, extra: str = "") -> str:
    """The twin of digest: issues gives (doc_id, x), state is an expression over docs d left join issues i."""
    return f"WITH {lift}, {extra}iss AS ({issues}), i AS (SELECT doc_id, string_agg(x, ';' ORDER BY x) AS issues FROM iss GROUP BY doc_id) SELECT d.doc_id, {state} AS state, coalesce(i.issues, '') AS issues FROM {docs} d LEFT JOIN i USING (doc_id)"


def rule(make, fn):
    def run(spark, sf_dir):
        f = make(spark, sf_dir)
        return digest(f, fn(f))

    return run


DUP = "SELECT doc_id, block_id, count(*) AS n FROM blocks GROUP BY doc_id, block_id HAVING count(*) > 1"
DUP_ORDER = "SELECT doc_id, order_index, count(*) AS n FROM blocks WHERE order_index IS NOT NULL GROUP BY doc_id, order_index HAVING count(*) > 1"
EMPTY = "trim(line, ' ' || chr(9) || chr(13)) = ''"
MARKS = " + ".join(f"(length(markdown) - length(replace(markdown, '{m}', ''))) // {len(m)}" for m in content.MOJIBAKE)
BAD_BOX = "NOT (bbox[3] > bbox[1] AND CASE WHEN bottom THEN bbox[2] > bbox[4] ELSE bbox[4] > bbox[2] END)"


def _bbox_text() -> str:
    return "'[' || bbox[1] || '.0,' || bbox[2] || '.0,5.0,50.0]'"


def skipped_facts(spark, sf_dir) -> DataFrame:
    f = text_facts(spark, sf_dir)
    return gate.requirement_checks(f).groupBy("doc_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("applicable")).alias("not_applicable"), F.count_if("blocked").alias("blocked"))


# ---- headings

TREE_SQL = HEADING_SQL + """,
conflict AS (SELECT DISTINCT doc_id FROM heads GROUP BY doc_id, order_index HAVING count(*) > 1),
lv AS (SELECT doc_id, max(c) > 1 AS suspect FROM (SELECT doc_id, heading_level, count(DISTINCT numbered) AS c FROM heads WHERE heading_level IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
uni AS (SELECT doc_id, count(DISTINCT heading_level) = 1 AND count(*) > 1 AS uniform FROM heads GROUP BY doc_id),
o AS (SELECT h.*, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(order_index, -1), block_id) AS rn, coalesce(suspect, false) OR uniform AS rebuild FROM heads h LEFT JOIN lv USING (doc_id) JOIN uni USING (doc_id)),
e AS (SELECT *, CASE WHEN rebuild THEN coalesce(numbered, heading_level, CASE WHEN rn = 1 THEN 1 END) ELSE coalesce(heading_level, numbered) END AS level,
  CASE WHEN rebuild THEN 'numbering' WHEN heading_level IS NOT NULL THEN 'parser_level' ELSE 'numbering' END AS src FROM o),
par AS (SELECT a.doc_id, a.rn, max(b.rn) AS prn FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.rn < a.rn AND b.level < a.level GROUP BY a.doc_id, a.rn),
t AS (SELECT a.*, prn, b.block_id AS pid, b.level AS plevel, b.source_block_id AS psrc, b.order_index AS pord, c.doc_id IS NOT NULL AS conflict, a.level IS NOT NULL AND a.level > 1 AND prn IS NULL AS orphan
  FROM e a LEFT JOIN par USING (doc_id, rn) LEFT JOIN e b ON b.doc_id = a.doc_id AND b.rn = prn LEFT JOIN conflict c ON c.doc_id = a.doc_id),
u AS (SELECT *, coalesce(bool_or(orphan) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS orphan_before FROM t),
rel AS (SELECT doc_id, pid AS from_id, block_id AS to_id, CASE WHEN conflict OR orphan_before THEN 'manual_review_required'
  WHEN level > plevel + 1 OR src <> 'parser_level' OR psrc IS NULL OR source_block_id IS NULL THEN 'inferred' ELSE 'verified' END AS state FROM u WHERE prn IS NOT NULL)"""


def heading_relations(spark, sf_dir) -> DataFrame:
    return structure.build_tree(heading_facts(spark, sf_dir)).relations.select("doc_id", "from_id", "to_id", "state")


def section_paths(spark, sf_dir) -> DataFrame:
    f = heading_facts(spark, sf_dir)
    return structure.section_paths(f.blocks.filter("heading_level is not null")).select("doc_id", "block_id", F.array_join("path", " > ").alias("path"))


SECTION_SQL = f"""WITH {HEADING_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(order_index, -1), block_id) AS rn FROM heads WHERE heading_level IS NOT NULL),
x AS (SELECT a.doc_id, a.block_id, b.title, b.rn FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.rn <= a.rn
  WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.doc_id = a.doc_id AND c.rn > b.rn AND c.rn <= a.rn AND c.heading_level <= b.heading_level))
SELECT doc_id, block_id, string_agg(title, ' > ' ORDER BY rn) AS path FROM x GROUP BY doc_id, block_id"""


# ---- citations


def citation_relations(spark, sf_dir) -> DataFrame:
    return structure.bind_citations(citation_facts(spark, sf_dir)).relations.select("doc_id", "from_id", "to_id", "state", "marker_key")


BOUND = CITATION_SQL + """, ent AS (SELECT doc_id, key, count(*) AS n, min(block_id) AS entry, arg_min(source_block_id, block_id) AS esrc, arg_min(source_block_id IS NULL, block_id) AS enull FROM entries GROUP BY doc_id, key),
x AS (SELECT m.doc_id, m.block_id, m.source_block_id, m.pos, m.marker, unnest(labels) AS label, unnest(range(len(labels))) AS k FROM marks m),
j AS (SELECT x.*, ent.n, ent.entry, ent.enull, count(*) FILTER (n IS NULL OR n > 1) OVER (PARTITION BY x.doc_id, x.block_id, x.pos) AS bad FROM x LEFT JOIN ent ON ent.doc_id = x.doc_id AND ent.key = x.label::VARCHAR)"""


# ---- tables


def grid(spark, sf_dir) -> DataFrame:
    a = tables.analysis(table_facts(spark, sf_dir))
    return a.select("doc_id", "table_id", F.col("rows").cast("long").alias("n_rows"), F.size("heads").cast("long").alias("n_heads"), "inferred", "n_conflict", "n_holes", "n_overflow", "valid")


#: header rows: 1 where given or marked; where nothing tells, a merged top row, else the first row by default
GRID_SQL = TABLE_SQL + """, g AS (SELECT t.doc_id, t.table_id, t.k, t.n, CASE WHEN t.n = 0 THEN coalesce(num_rows, 0) ELSE t.n + 1 END AS n_rows, t.num_rows,
  CASE WHEN n = 0 THEN 0 WHEN k % 4 = 3 THEN CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END ELSE 1 END AS n_heads,
  CASE WHEN n > 0 AND k % 9 = 0 THEN 1 ELSE 0 END AS n_conflict, CASE WHEN n > 0 AND k % 7 = 0 THEN 1 ELSE 0 END AS n_holes FROM tabs t)"""


def bindings(spark, sf_dir) -> DataFrame:
    b = tables.bindings(table_facts(spark, sf_dir))
    return b.select("doc_id", "table_id", "cell_id", "row_key", F.array_join("column_path", "/").alias("column_path"), "value", "state")


def column_paths(spark, sf_dir) -> DataFrame:
    f = table_facts(spark, sf_dir)
    p = tables.column_paths(tables.analysis(f).filter("valid"), f.cells, f.buckets)
    return p.select("doc_id", "table_id", F.col("c").cast("long").alias("col"), F.array_join("path", "/").alias("path"))


def continuations(spark, sf_dir) -> DataFrame:
    return tables.continuation(table_facts(spark, sf_dir)).relations.select("doc_id", "from_id", "to_id", "state", "marker_key")


VALID = "n > 0 AND k % 9 <> 0 AND k % 7 <> 0"
#: a table's first-column keys repeat where two lines have the same number
BINDING_SQL = f"""WITH {GRID_SQL}, v AS (SELECT * FROM g WHERE {VALID}), first AS (SELECT b.k, b.start_row, b.text, count(*) OVER (PARTITION BY b.k, b.text) > 1 AS repeated FROM body b JOIN v USING (k) WHERE b.start_col = 0),
zero AS (SELECT k, 0 AS start_row, 'line' AS text, false AS repeated FROM v WHERE n_heads = 0)
SELECT v.doc_id, v.table_id, v.table_id || ':' || b.start_row || '.' || b.start_col AS cell_id, f.text AS row_key, h.text AS column_path, b.text AS value,
  CASE WHEN f.repeated OR v.k % 10 = 0 THEN 'manual_review_required' WHEN v.k % 4 IN (0, 1) AND (v.k % 3 = 0 OR v.k % 8 = 0) THEN 'verified' ELSE 'inferred' END AS state
FROM v JOIN body b USING (k) JOIN first f ON f.k = b.k AND f.start_row = b.start_row JOIN head h ON h.k = b.k AND b.start_col >= h.start_col AND b.start_col < h.start_col + h.col_span
WHERE v.n_heads > 0 AND NOT (b.start_col = 0 AND (v.k % 3 = 0 OR v.k % 8 = 0))"""

PAIR_SQL = f"""{GRID_SQL}, p AS (SELECT a.*, b.k AS k2, b.n AS n2, b.n_rows AS r2, b.n_heads AS h2 FROM g a JOIN tabs ta USING (table_id) JOIN tabs tb ON tb.doc_id = a.doc_id AND tb.page = ta.page + 1 JOIN g b ON b.table_id = tb.table_id),
v AS (SELECT * FROM p WHERE {VALID} AND {VALID.replace('n_rows', 'r2').replace('n >', 'n2 >').replace('k %', 'k2 %')}),
w AS (SELECT *, (k % 13 = 0 OR k2 % 13 = 0) AS hint, (CASE WHEN n_heads = 0 THEN 0 WHEN k % 6 = 0 THEN 1 ELSE 2 END) = (CASE WHEN h2 = 0 THEN 0 WHEN k2 % 6 = 0 THEN 1 ELSE 2 END) AS same, n_heads > 0 AND h2 > 0 AS both_heads FROM v)"""
#: tables have four columns each, so only headers can drift
DRIFT_SQL = f"WITH {PAIR_SQL} SELECT doc_id, count(*) AS n FROM w WHERE NOT same AND (hint OR both_heads) GROUP BY doc_id"
#: a binding is closed if its own cell, the row's first cell and the header over its column are canonical
CLOSED_SQL = BINDING_SQL.replace("SELECT v.doc_id, v.table_id, v.table_id || ':'", "SELECT v.doc_id, v.table_id, b.start_row, b.start_col, h.start_col AS head_col, v.table_id || ':'")
CLOSED_SQL = f"SELECT doc_id, table_id, count(*) AS n FROM ({CLOSED_SQL}) WHERE (start_row + start_col) % 3 <> 0 AND start_row % 3 <> 0 AND head_col % 3 <> 0 GROUP BY doc_id, table_id"
INDEX_SQL = f"SELECT state, count(*) AS n FROM ({BINDING_SQL.replace('f.repeated OR v.k % 10 = 0', 'f.repeated')}) GROUP BY state"
TREE_ISSUES = """SELECT doc_id, 'warning|headings share an order_index|' || count(*) AS x, '' AS at FROM u WHERE conflict GROUP BY doc_id
UNION ALL SELECT doc_id, 'info|heading levels come from numbers|' || count(*), '' FROM u WHERE rebuild GROUP BY doc_id UNION ALL SELECT doc_id, 'warning|no level: ' || title || '|1', block_id FROM u WHERE level IS NULL
UNION ALL SELECT doc_id, 'warning|no parent at level ' || level || ': ' || title || '|1', block_id FROM u WHERE orphan UNION ALL SELECT doc_id, 'info|level ' || plevel || ' to ' || level || ': ' || title || '|2', block_id FROM u WHERE prn IS NOT NULL AND level > plevel + 1"""
#: headings have no tables, boxes, links or citations: order, levels, source ids and the tree are what is left to complain about
ALL_RULES_SQL = f"""WITH {TREE_SQL}, x AS (SELECT DISTINCT 1 AS r, * FROM ({TREE_ISSUES}) UNION ALL SELECT 2, doc_id, 'no level', '' FROM (SELECT DISTINCT doc_id FROM heads WHERE heading_level IS NULL) UNION ALL SELECT 3, doc_id, 'no number', '' FROM (SELECT DISTINCT doc_id FROM heads WHERE heading_level IS NULL AND numbered IS NULL)
  UNION ALL SELECT 4, doc_id, 'no source', '' FROM (SELECT DISTINCT doc_id FROM heads WHERE source_block_id IS NULL) UNION ALL SELECT 5, doc_id, order_index::VARCHAR, '' FROM heads GROUP BY doc_id, order_index HAVING count(*) > 1 UNION ALL SELECT DISTINCT 6, doc_id, 'uncertain order', '' FROM heads GROUP BY doc_id, order_index HAVING count(*) > 1),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id) SELECT doc_id, 'pass_with_warnings' AS state, 0::BIGINT AS critical_issues, coalesce(n, 0)::BIGINT AS other_issues FROM (SELECT DISTINCT doc_id FROM heads) LEFT JOIN n USING (doc_id)"""
#: a table without cells is critical; every table of a document lacks them in one warning; twice taken slots, holes and columns without header count by table and column
TABLE_GATE_SQL = f"""WITH {GRID_SQL}, d AS (SELECT doc_id, count(*) FILTER (n = 0) AS crit, (count(*) FILTER (n = 0) > 0)::INT + sum(n_conflict) + sum(n_holes) + 4 * count(*) FILTER ({VALID} AND k % 5 <> 0 AND n_heads = 0) AS other, bool_or(n > 0 AND k % 4 = 2) AS guessed FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN crit > 0 THEN 'rejected' WHEN other > 0 OR guessed THEN 'pass_with_warnings' ELSE 'pass' END AS state, crit::BIGINT AS critical_issues, other::BIGINT AS other_issues FROM d"""

QUERIES = {
    "cont_001_blocks_exist": rule(text_facts, content.blocks_exist),
    "cont_002_order_index": rule(text_facts, content.order_index),
    "cont_003_kind_content": rule(text_facts, content.kind_content),
    "cont_004_empty_content": rule(text_facts, content.empty_content),
    "fmt_001_mojibake": rule(text_facts, content.mojibake),
    "asset_001_data_uri": rule(text_facts, content.data_uri),
    "prov_001_source_traceable": rule(text_facts, content.source_traceable),
    "prov_002_anchor_valid": rule(text_facts, content.anchors_valid),
    "prov_004_capability_reasons": rule(text_facts, content.capability_reasons),
    "fil_02_evidence_requirements": skipped_facts,
    "hdg_001_heading_fields": rule(heading_facts, structure.heading_fields),
    "hdg_004_heading_tree": heading_relations,
    "hdg_004_tree_state": rule(heading_facts, structure.build_tree),
    "win_04_section_path": section_paths,
    "ref_001_reference_index": rule(citation_facts, structure.build_reference_index),
    "ref_004_bind_citations": citation_relations,
    "ref_004_citation_state": rule(citation_facts, structure.bind_citations),
    "tbl_001_grid_analysis": grid,
    "tbl_004_column_path": column_paths,
    "tbl_006_bindings": bindings,
    "tbl_007_continuation": continuations,
}

BLOCK_ISSUE = "FROM blocks WHERE {} GROUP BY doc_id"
ORACLES = {
    "cont_001_blocks_exist": digest_sql(TEXT_SQL, "docs", f"SELECT doc_id, 'critical|duplicate block id ' || block_id || '|1' AS x FROM ({DUP})", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'rejected' END"),
    "cont_002_order_index": digest_sql(TEXT_SQL, "docs", f"SELECT doc_id, 'warning|' || count(*) || ' blocks lack order_index|' || count(*) AS x FROM blocks WHERE order_index IS NULL GROUP BY doc_id UNION ALL SELECT doc_id, 'warning|order_index ' || order_index || ' is shared by ' || n || ' blocks|' || n FROM ({DUP_ORDER})", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'manual_review_required' END"),
    "cont_003_kind_content": digest_sql(TEXT_SQL, "docs", "SELECT doc_id, 'warning|' || count(*) || ' headings lack heading_level|' || count(*) AS x " + BLOCK_ISSUE.format("kind = 'heading' AND heading_level IS NULL") + " UNION ALL SELECT doc_id, 'warning|' || count(*) || ' table blocks lack a table|' || count(*) " + BLOCK_ISSUE.format("kind = 'table'") + " UNION ALL SELECT doc_id, 'info|' || count(*) || ' blocks are empty|' || count(*) " + BLOCK_ISSUE.format(f"kind <> 'table' AND {EMPTY}"), "CASE WHEN i.issues LIKE '%warning|%' THEN 'manual_review_required' WHEN i.doc_id IS NOT NULL THEN 'inferred' ELSE 'verified' END"),
    "cont_004_empty_content": digest_sql(TEXT_SQL, "docs", "SELECT doc_id, 'critical|normalised content is blank|' || count(*) AS x FROM blocks JOIN docs USING (doc_id) WHERE trim(markdown, ' ' || chr(9) || chr(10) || chr(13)) = '' GROUP BY doc_id", "''"),
    "fmt_001_mojibake": digest_sql(TEXT_SQL, "docs", "SELECT m.doc_id, 'critical|unreadable text: ' || concat_ws(', ', CASE WHEN r > 0 THEN r || ' replacement characters' END, CASE WHEN e > 0 THEN e || ' encoding marks' END, CASE WHEN c > 0 THEN c || ' control characters' END) || '|' || b AS x FROM m JOIN mb USING (doc_id) WHERE r >= 2 OR e >= 2 OR c > 0", "''", f"m AS (SELECT doc_id, length(markdown) - length(replace(markdown, chr(65533), '')) AS r, {MARKS} AS e, len(regexp_extract_all(markdown, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS c FROM docs), mb AS (SELECT doc_id, count(*) FILTER ({' OR '.join(f'''contains(line, '{m}')''' for m in content.MOJIBAKE)} OR contains(line, chr(65533))) AS b FROM blocks GROUP BY doc_id), "),
    "asset_001_data_uri": digest_sql(TEXT_SQL, "docs", "SELECT doc_id, 'critical|' || n || ' data URIs remain|' || b AS x FROM (SELECT doc_id, len(regexp_extract_all(markdown, '(?i)data:image/[^,\\s]+,')) AS n FROM docs) JOIN (SELECT doc_id, count(*) FILTER (contains(lower(line), 'data:image/')) AS b FROM blocks GROUP BY doc_id) USING (doc_id) WHERE n > 0", "''"),
    "prov_001_source_traceable": digest_sql(TEXT_SQL, "docs", "SELECT doc_id, 'warning|' || count(*) || ' blocks lack source_block_id|' || count(*) AS x " + BLOCK_ISSUE.format("source_block_id IS NULL") + " UNION ALL SELECT doc_id, 'warning|' || count(*) || ' source_block_ids are shared|' || sum(n)::BIGINT FROM (SELECT doc_id, source_block_id, count(*) AS n FROM blocks WHERE source_block_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'manual_review_required' END"),
    "prov_002_anchor_valid": digest_sql(TEXT_SQL, "docs", f"SELECT doc_id, 'warning|block box is invalid: ' || {_bbox_text()} || '|1' AS x FROM blocks WHERE bbox IS NOT NULL AND {BAD_BOX} UNION ALL SELECT doc_id, 'warning|granularity line without a box|1' FROM blocks WHERE bbox IS NULL AND granularity IS NOT NULL", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'manual_review_required' END"),
    "prov_004_capability_reasons": digest_sql(TEXT_SQL, "docs", "SELECT doc_id, 'critical|capability ' || name || ' is ' || state || ' without a reason|0' AS x FROM caps WHERE state <> 'available' AND reason IS NULL", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'rejected' END"),
    "fil_02_evidence_requirements": f"WITH {TEXT_SQL} SELECT d.doc_id, 11::BIGINT AS checks, 6::BIGINT AS not_applicable, CASE WHEN p.doc_id IS NULL THEN 5 ELSE 0 END::BIGINT AS blocked FROM docs d LEFT JOIN (SELECT doc_id FROM caps WHERE name = 'page_bbox') p USING (doc_id)",
    "hdg_001_heading_fields": digest_sql(HEADING_SQL, "(SELECT DISTINCT doc_id FROM heads)", "SELECT doc_id, 'warning|' || count(*) || ' headings have neither level nor number|' || count(*) AS x FROM heads WHERE heading_level IS NULL AND numbered IS NULL GROUP BY doc_id", "CASE WHEN i.doc_id IS NULL THEN 'verified' ELSE 'manual_review_required' END"),
    "hdg_004_heading_tree": f"WITH {TREE_SQL} SELECT * FROM rel",
    "hdg_004_tree_state": digest_sql(TREE_SQL, "(SELECT doc_id, count(r.doc_id) AS n, count(*) FILTER (r.state = 'verified') AS v, bool_or(r.state = 'manual_review_required') AS m FROM (SELECT DISTINCT doc_id FROM heads) LEFT JOIN rel r USING (doc_id) GROUP BY doc_id)", f"SELECT doc_id, x FROM ({TREE_ISSUES})", "CASE WHEN i.issues LIKE '%no parent%' OR i.issues LIKE '%share an%' THEN 'manual_review_required' WHEN n = 0 THEN '' WHEN v = n THEN 'verified' WHEN m THEN 'manual_review_required' ELSE 'inferred' END"),
    "win_04_section_path": SECTION_SQL,
    "ref_001_reference_index": "WITH n AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS doc_id FROM nation), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT doc_id, CASE WHEN s.k IS NOT NULL THEN 'verified' ELSE 'unavailable' END AS state, CASE WHEN s.k IS NULL THEN 'info|a reference heading without entries|0' ELSE '' END AS issues FROM n LEFT JOIN s USING (k)",
    "ref_004_bind_citations": f"WITH {BOUND} SELECT doc_id, block_id AS from_id, entry AS to_id, CASE WHEN source_block_id IS NULL OR enull THEN 'inferred' ELSE 'verified' END AS state, pos || ':' || marker AS marker_key FROM j WHERE bad = 0",
    "ref_004_citation_state": digest_sql(BOUND, "(SELECT n_nationkey::VARCHAR AS doc_id, s.doc_id IS NOT NULL AS has, coalesce(r.n, 0) AS n, coalesce(r.v, 0) AS v FROM nation LEFT JOIN (SELECT DISTINCT doc_id FROM entries) s ON s.doc_id = n_nationkey::VARCHAR LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (source_block_id IS NOT NULL AND NOT enull) AS v FROM j WHERE bad = 0 GROUP BY doc_id) r ON r.doc_id = n_nationkey::VARCHAR)", "SELECT doc_id, 'warning|' || marker || ' lacks entries: ' || string_agg(label::VARCHAR, ', ' ORDER BY k) || '|1' AS x FROM j WHERE n IS NULL GROUP BY doc_id, block_id, pos, marker UNION ALL SELECT doc_id, 'warning|' || marker || ' has several entries: ' || string_agg(label::VARCHAR, ', ' ORDER BY k) || '|1' FROM j WHERE n > 1 GROUP BY doc_id, block_id, pos, marker", "CASE WHEN NOT has THEN '' WHEN n > 0 AND v = n THEN 'verified' WHEN n > 0 OR i.doc_id IS NOT NULL THEN 'manual_review_required' ELSE 'unavailable' END"),
    "tbl_001_grid_analysis": f"WITH {GRID_SQL} SELECT doc_id, table_id, n_rows::BIGINT AS n_rows, n_heads::BIGINT AS n_heads, k % 4 IN (2, 3) AND n_heads > 0 AS inferred, n_conflict::BIGINT AS n_conflict, n_holes::BIGINT AS n_holes, 0::BIGINT AS n_overflow, n > 0 AND n_conflict = 0 AND n_holes = 0 AS valid FROM g",
    "tbl_004_column_path": f"WITH {GRID_SQL}, v AS (SELECT * FROM g WHERE {VALID}) SELECT doc_id, table_id, c AS col, CASE WHEN n_heads > 0 THEN (SELECT text FROM head h WHERE h.k = v.k AND v.c >= h.start_col AND v.c < h.start_col + h.col_span) ELSE '' END AS path FROM (SELECT *, unnest(range(4)) AS c FROM v) v",
    "tbl_006_bindings": BINDING_SQL,
    "tbl_007_continuation": f"WITH {PAIR_SQL} SELECT doc_id, 'b' || k AS from_id, 'b' || k2 AS to_id, CASE WHEN same AND hint AND k % 10 <> 0 AND k2 % 10 <> 0 THEN 'verified' ELSE 'manual_review_required' END AS state, k || '->' || k2 AS marker_key FROM w WHERE hint OR same OR both_heads",
}
