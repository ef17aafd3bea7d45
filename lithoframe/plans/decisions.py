"""Queries on the gate, the capability matrix, repairs, routing and the lifecycle, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.session import materialized
from lithoframe.operators import gate, lifecycle, repairs, routing
from lithoframe.operators.model import RANK, Facts
from lithoframe.plans.rules import ALL_RULES_SQL, BAD_BOX, EMPTY, TABLE_GATE_SQL, TEXT_SQL
from lithoframe.sources.lift import heading_facts, table, table_facts, text_facts

#: the rules whose verdicts the gate query combines (whole documents of lines have no tables)
CORE = ("QL-CONT-001", "QL-CONT-002", "QL-CONT-003", "QL-CONT-004", "QL-PROV-001", "QL-PROV-002", "QL-PROV-004")


def core(spark: SparkSession, sf_dir: str) -> tuple[Facts, dict[str, DataFrame]]:
    f = text_facts(spark, sf_dir)
    f.blocks = materialized(f.blocks)  # every rule reads them
    return f, gate.run_quality(f, {r: gate.RULES[r] for r in CORE})


def gate_decision(spark, sf_dir) -> DataFrame:
    _, r = core(spark, sf_dir)
    return r["gate"].select("doc_id", "state", "critical_issues", "other_issues", F.array_join("blockers", ",").alias("blockers"))


def matrix(spark, sf_dir) -> DataFrame:
    _, r = core(spark, sf_dir)
    return r["matrix"].select("doc_id", "capability", "state", "applicable", "blocking")


FLAGS_SQL = TEXT_SQL + f""", f AS (SELECT d.doc_id, dup, miss, dupo, lvl, tab, empt, blank, srcs, dups, box, caps_bad, has_bbox FROM docs d
  JOIN (SELECT doc_id, count(*) FILTER (order_index IS NULL) > 0 AS miss, count(*) FILTER (kind = 'heading' AND heading_level IS NULL) > 0 AS lvl, count(*) FILTER (kind = 'table') > 0 AS tab, count(*) FILTER (kind <> 'table' AND {EMPTY}) > 0 AS empt, count(*) FILTER (source_block_id IS NULL) > 0 AS srcs,
    count(*) FILTER (bbox IS NOT NULL AND {BAD_BOX}) + count(*) FILTER (bbox IS NULL AND granularity IS NOT NULL) AS box FROM blocks GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS dup FROM (SELECT doc_id, block_id FROM blocks GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS dupo FROM (SELECT doc_id, order_index FROM blocks WHERE order_index IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, 1 AS dups FROM (SELECT doc_id, source_block_id FROM blocks WHERE source_block_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (state <> 'available' AND reason IS NULL) AS caps_bad, count(*) FILTER (name = 'page_bbox') AS has_bbox FROM caps GROUP BY doc_id) USING (doc_id)
  JOIN (SELECT doc_id, trim(markdown, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM docs) USING (doc_id)),
g AS (SELECT *, coalesce(has_bbox, 0) > 0 AS seen FROM f),
-- boxes: equal messages on equal blocks count once
bx AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, block_id || bbox::VARCHAR AS x FROM blocks WHERE bbox IS NOT NULL AND {BAD_BOX} UNION ALL SELECT doc_id, block_id || granularity FROM blocks WHERE bbox IS NULL AND granularity IS NOT NULL) GROUP BY doc_id)"""

GATE_SQL = f"""WITH {FLAGS_SQL}, c AS (SELECT g.*, coalesce(dup, 0) + coalesce(caps_bad, 0) + blank::INT AS crit,
  CASE WHEN seen THEN miss::INT + coalesce(dupo, 0) + coalesce(n, 0) ELSE 2 END + lvl::INT + tab::INT + empt::INT + srcs::INT + coalesce(dups, 0) AS other FROM g LEFT JOIN bx USING (doc_id))
SELECT doc_id, CASE WHEN crit > 0 THEN 'rejected' ELSE 'pass_with_warnings' END AS state, crit::BIGINT AS critical_issues, other::BIGINT AS other_issues, CASE WHEN dup > 0 THEN 'content_complete' ELSE '' END AS blockers FROM c"""

MATRIX_SQL = f"""WITH {FLAGS_SQL}, m AS (SELECT doc_id, unnest(['content_complete', 'provenance_reliable', 'reading_order_reliable', 'kind_content_consistent', 'capability_declaration_valid', 'heading_tree_reliable', 'non_table_relation_reliable', 'table_grid_reliable', 'table_structure_reliable', 'table_view_scope_reliable', 'table_representation_reliable', 'table_field_binding_reliable']) AS capability, g.* EXCLUDE (doc_id) FROM g),
s AS (SELECT doc_id, capability, CASE capability WHEN 'content_complete' THEN CASE WHEN dup > 0 THEN 'rejected' ELSE 'verified' END
  WHEN 'provenance_reliable' THEN CASE WHEN srcs OR dups IS NOT NULL OR (seen AND box > 0) THEN 'manual_review_required' ELSE 'verified' END
  WHEN 'reading_order_reliable' THEN CASE WHEN NOT seen THEN NULL WHEN miss OR dupo > 0 THEN 'manual_review_required' ELSE 'inferred' END
  WHEN 'kind_content_consistent' THEN CASE WHEN lvl OR tab THEN 'manual_review_required' ELSE 'inferred' END
  WHEN 'capability_declaration_valid' THEN CASE WHEN caps_bad > 0 THEN 'rejected' ELSE 'inferred' END ELSE 'unavailable' END AS state FROM m)
SELECT doc_id, capability, state, capability NOT LIKE 'table%' AS applicable, capability IN ('content_complete', 'provenance_reliable') AND state <> 'verified' AS blocking FROM s WHERE state IS NOT NULL"""


def worst_state(spark, sf_dir) -> DataFrame:
    """AGG-02 over line items: the worst of a customer's states."""
    names = F.array(*[F.lit(s) for s in RANK])
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("c").alias("capability"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("state"), F.array(F.concat(F.lit("r"), (F.col("o_orderkey") % 4).cast("string"))).alias("refs"))
    return gate.merged_observations(o).select("doc_id", "state", F.array_join("refs", ",").alias("refs"))


def pipeline_metrics(spark, sf_dir) -> DataFrame:
    _, r = core(spark, sf_dir)
    return gate.metrics(r).groupBy("state").agg(F.count("*").alias("docs"), F.sum("n_critical").alias("critical"), F.sum("n_verified_capabilities").alias("verified"), F.sum("n_unavailable_capabilities").alias("unavailable"))


METRICS_SQL = f"""WITH gd AS ({GATE_SQL}), mx AS ({MATRIX_SQL}), v AS (SELECT doc_id, count(*) FILTER (state = 'verified') AS v, count(*) FILTER (state = 'unavailable') AS u FROM mx GROUP BY doc_id)
SELECT state, count(*) AS docs, sum(critical_issues)::BIGINT AS critical, sum(v)::BIGINT AS verified, sum(u)::BIGINT AS unavailable FROM gd JOIN v USING (doc_id) GROUP BY state"""


def run_all_rules(spark, sf_dir) -> DataFrame:
    """All 22 rules, repairs and the second pass over documents of headings."""
    r = gate.run_quality(heading_facts(spark, sf_dir), repair=repairs.repair_all)
    return r["gate"].select("doc_id", "state", "critical_issues", "other_issues")


def table_rules(spark, sf_dir) -> DataFrame:
    """The table rules' gate over documents of tables."""
    r = gate.run_quality(table_facts(spark, sf_dir), {k: v for k, v in gate.RULES.items() if k in ("QL-CONT-001", "QL-TBL-004", "QL-TBL-010", "QL-TBL-003")})
    return r["gate"].select("doc_id", "state", "critical_issues", "other_issues")


# ---- repairs


def spaced(spark, sf_dir) -> DataFrame:
    """documents with blanks added to line ends, by the length of the line."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(x, F.when(F.length(x) % 3 == 0, "  ").when(F.length(x) % 3 == 1, " \t").otherwise("")))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(lines, "\n").alias("markdown"))


SPACED_SQL = "s AS (SELECT doc_id::VARCHAR AS doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: x || CASE length(x) % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || chr(9) ELSE '' END), chr(10)) AS markdown FROM documents)"


def trailing_space(spark, sf_dir) -> DataFrame:
    m = F.col("markdown")
    return spaced(spark, sf_dir).select("doc_id", F.sha2(repairs.trailing_space(m), 256).alias("after"), repairs.trailing_space_lines(m).alias("lines"))


def repair_chain(spark, sf_dir) -> DataFrame:
    """Both text repairs with records, replay and rollback of the last one."""
    docs, rec = repairs.repair_text(spaced(spark, sf_dir))
    again, none = repairs.repair_text(docs)
    back = repairs.rollback(docs, rec)
    r = repairs.replay(rec).groupBy("doc_id").agg(F.count("*").alias("records"), F.bool_and("ok").alias("replays"))
    n = none.groupBy("doc_id").agg(F.count("*").alias("again"))
    b = back.groupBy("doc_id").agg(F.bool_and("undone").alias("undone"))
    return docs.select("doc_id").join(r, "doc_id", "left").join(n, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("again", F.lit(0)).alias("again"), "replays", "undone")


def affected(spark, sf_dir) -> DataFrame:
    s = spaced(spark, sf_dir).select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "markdown")).withColumn("block_id", F.col("pos").cast("string"))
    return repairs.affected_blocks(s).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


def resolved_issues(spark, sf_dir) -> DataFrame:
    """SET-03: issues of a first pass over raw lines that a pass over the repaired ones no longer has."""
    d = spaced(spark, sf_dir)

    def found(docs):
        l = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
        return l.filter(F.col("line").rlike("[ \\t]$") | (F.length("line") < 20)).select("doc_id", F.lit("R").alias("rule_id"), F.lit("c").alias("category"), F.lit("open").alias("status"), F.lit("info").alias("severity"), F.when(F.length("line") < 20, F.concat(F.lit("short "), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("blank end "), F.col("pos").cast("string"))).alias("message"), F.array().cast("array<string>").alias("blocks"))

    return gate.resolved(gate.distinct_issues(found(d)), gate.distinct_issues(found(repairs.repair_text(d)[0]))).groupBy("doc_id").agg(F.count("*").alias("n_resolved"))


# ---- routing


def requests(spark, sf_dir) -> DataFrame:
    """orders as routing requests: the extension, profile and flags come from the key."""
    exts = (".md", ".csv", ".xlsx", ".doc", ".docx", ".html", ".pdf", ".png", ".bin", ".xls")
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in exts]), (k % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), ext.alias("ext"), (k % 4 == 0).alias("quality_first"), (k % 3 == 0).alias("libreoffice"), (k % 5 < 2).alias("allow_cloud"), F.element_at(F.array(*[F.lit(p[0]) for p in routing.PARSERS]), (k % 7 % 5 + 1).cast("int")).alias("parser_id"))


def route_automatic(spark, sf_dir) -> DataFrame:
    r = routing.automatic(requests(spark, sf_dir), routing.registry(spark))
    return r.select("request_id", "ext", "selected", F.array_join("fallbacks", ",").alias("fallbacks"), F.array_join("unavailable", ";").alias("unavailable"), "may_fall_back", "error")


def route_manual(spark, sf_dir) -> DataFrame:
    return routing.manual(requests(spark, sf_dir), routing.registry(spark))


def route_reparse(spark, sf_dir) -> DataFrame:
    k = F.col("request_id")
    r = requests(spark, sf_dir).withColumns({"attempted": F.when(k % 6 == 0, F.array("parser_id")).otherwise(F.array(F.lit("other"))), "options": F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), "more": F.create_map(F.lit("b"), F.lit("3"))})
    return routing.reparse(r, routing.registry(spark)).select("request_id", "error", "selected", F.array_join(F.array_sort(F.transform(F.map_entries("options"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("options"))


_LIST = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
REQUEST_SQL = f"""r AS (SELECT o_orderkey AS request_id, {_LIST((".md", ".csv", ".xlsx", ".doc", ".docx", ".html", ".pdf", ".png", ".bin", ".xls"))}[o_orderkey % 10 + 1] AS ext, o_orderkey % 4 = 0 AS quality, o_orderkey % 3 = 0 AS office, o_orderkey % 5 < 2 AS cloud, {_LIST([p[0] for p in routing.PARSERS])}[o_orderkey % 7 % 5 + 1] AS parser_id FROM orders),
p(parser_id, formats, net, avail, reason) AS (VALUES {", ".join(f"('{p[0]}', {_LIST(p[1])}, {p[2]}, {p[3]}, {chr(39) + p[4] + chr(39) if p[4] else 'NULL'})" for p in routing.PARSERS)})"""
WHY = "CASE WHEN net AND NOT cloud THEN 'cloud forbidden' WHEN NOT (list_contains(formats, ext) OR (p.parser_id = 'markitdown' AND ext IN ('.doc', '.ppt', '.xls'))) THEN 'format not supported' WHEN NOT avail THEN reason END"
AUTO_SQL = f"""WITH {REQUEST_SQL}, c AS (SELECT request_id, ext, cloud, unnest(pl) AS parser_id, unnest(range(len(pl))) AS ord FROM (SELECT *, CASE ext WHEN '.md' THEN ['markitdown'] WHEN '.csv' THEN ['markitdown', 'docling', 'anydoc'] WHEN '.xlsx' THEN ['anydoc', 'markitdown'] WHEN '.xls' THEN ['anydoc', 'markitdown']
  WHEN '.doc' THEN CASE WHEN office THEN ['markitdown', 'anydoc', 'docling'] ELSE ['anydoc', 'markitdown'] END WHEN '.docx' THEN ['docling', 'anydoc', 'markitdown'] WHEN '.html' THEN ['docling', 'markitdown'] WHEN '.pdf' THEN ['mineru', 'docling', 'ocr', 'markitdown']
  WHEN '.png' THEN CASE WHEN quality THEN ['mineru', 'docling', 'ocr'] ELSE ['docling', 'ocr', 'mineru'] END ELSE ['markitdown'] END AS pl FROM r)),
j AS (SELECT c.*, {WHY} AS why FROM c JOIN p USING (parser_id)),
s AS (SELECT request_id, ext, list(parser_id ORDER BY ord) FILTER (why IS NULL) AS u, string_agg(parser_id || ': ' || why, ';' ORDER BY ord) FILTER (why IS NOT NULL) AS no FROM j GROUP BY ALL)
SELECT request_id, ext, u[1] AS selected, coalesce(array_to_string(u[2:], ','), '') AS fallbacks, coalesce(no, '') AS unavailable, coalesce(len(u), 0) > 1 AS may_fall_back, CASE WHEN u IS NULL THEN 'no executable parser' END AS error FROM s"""
MANUAL_SQL = f"WITH {REQUEST_SQL} SELECT request_id, ext, parser_id, {WHY} AS error, CASE WHEN {WHY} IS NULL THEN parser_id END AS selected FROM r JOIN p USING (parser_id)"
REPARSE_SQL = f"WITH {REQUEST_SQL}, m AS (SELECT request_id, parser_id, CASE WHEN request_id % 6 = 0 THEN 'already attempted' ELSE {WHY} END AS error FROM r JOIN p USING (parser_id)) SELECT request_id, error, CASE WHEN error IS NULL THEN parser_id END AS selected, CASE WHEN error IS NULL THEN 'a=1,b=3,reparse=true' END AS options FROM m"


def signals(spark, sf_dir) -> DataFrame:
    names = ("a.MD", "b.tar.Pdf", "c", "d.CSV")
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 4 + 1).cast("int")).alias("filename"), F.octet_length("text").alias("size"))
    return routing.signals(d).select("doc_id", "ext", "size_bytes", "has_text")


def attempts(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("failed"), F.max(F.col("l_quantity") < 10).alias("empty"))
    c = li.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("parser_id"), "failed", "empty")
    return routing.attempt(c).select("request_id", "selected", F.array_join("attempts", ",").alias("attempts"))


# ---- lifecycle


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """events as two scans of a folder: users are paths, the last event before and after mid-month their content."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("sha256"), "ts", "event_id")
    cutoff = F.lit("2024-01-16").cast("timestamp")
    last = lambda df: df.groupBy("path").agg(F.max_by("sha256", F.struct("ts", "event_id")).alias("sha256"))
    old = last(e.filter(F.col("ts") < cutoff)).filter(F.col("path").cast("long") % 7 != 0)
    state = old.select(F.concat(F.lit("id"), "path").alias("source_id"), "path", "sha256", F.when(F.col("path").cast("long") % 5 == 0, "parse_failed").when(F.col("path").cast("long") % 11 == 0, "deleted").otherwise("active").alias("state"))
    return state, last(e.filter(F.col("ts") >= cutoff)).filter(F.col("path").cast("long") % 6 != 0)


def reconcile(spark, sf_dir) -> DataFrame:
    return lifecycle.reconcile(*snapshots(spark, sf_dir)).select("kind", "path", "previous_path", F.when(F.col("kind") != "added", F.col("source_id")).alias("source_id"))


def reconcile_state(spark, sf_dir) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return lifecycle.next_state(old, lifecycle.reconcile(old, new)).groupBy("state").agg(F.count("*").alias("n"))


LIFE_SQL = """e AS (SELECT user_id::VARCHAR AS path, event_type AS sha, ts, event_id FROM events),
old AS (SELECT path, arg_max(sha, (ts, event_id)) AS sha, CASE WHEN path::BIGINT % 5 = 0 THEN 'parse_failed' WHEN path::BIGINT % 11 = 0 THEN 'deleted' ELSE 'active' END AS state FROM e WHERE ts < TIMESTAMP '2024-01-16' AND path::BIGINT % 7 <> 0 GROUP BY path),
live AS (SELECT * FROM old WHERE state <> 'deleted'), new AS (SELECT path, arg_max(sha, (ts, event_id)) AS sha FROM e WHERE ts >= TIMESTAMP '2024-01-16' AND path::BIGINT % 6 <> 0 GROUP BY path),
gone AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM live WHERE path NOT IN (SELECT path FROM new)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM new WHERE path NOT IN (SELECT path FROM live)),
ev AS (SELECT CASE WHEN l.sha = n.sha AND l.state = 'active' THEN 'unchanged' WHEN l.state = 'parse_failed' THEN 'retry' ELSE 'modified' END AS kind, n.path, NULL::VARCHAR AS previous_path, 'id' || l.path AS source_id FROM live l JOIN new n USING (path)
  UNION ALL SELECT CASE WHEN g.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' ELSE 'moved' END, coalesce(f.path, g.path), CASE WHEN f.path IS NOT NULL THEN g.path END, 'id' || g.path FROM fresh f FULL JOIN gone g ON f.sha = g.sha AND f.n = g.n)"""

QUERIES = {
    "gate_decision": gate_decision, "agg_03_capability_matrix": matrix, "agg_02_worst_state": worst_state, "agg_05_pipeline_metrics": pipeline_metrics, "rules_all_documents": run_all_rules, "rules_tables_gate": table_rules,
    "rpr_001_trailing_space": trailing_space, "rpr_chain_replay_rollback": repair_chain, "rpr_aff_affected_blocks": affected, "set_03_resolved": resolved_issues,
    "rte_02_automatic": route_automatic, "rte_03_manual": route_manual, "rte_04_reparse": route_reparse, "rte_06_signals": signals, "rte_07_attempts": attempts,
    "str_01_reconcile": reconcile, "str_01_state": reconcile_state,
}
SP = "regexp_replace(markdown, '[ \\t]+(\\n|$)', '\\1', 'g')"
ORACLES = {
    "gate_decision": GATE_SQL, "agg_03_capability_matrix": MATRIX_SQL, "agg_05_pipeline_metrics": METRICS_SQL,
    "agg_02_worst_state": f"SELECT o_custkey::VARCHAR AS doc_id, {_LIST(list(RANK))}[max(o_orderkey % 6) + 1] AS state, string_agg(DISTINCT 'r' || (o_orderkey % 4), ',' ORDER BY 'r' || (o_orderkey % 4)) AS refs FROM orders GROUP BY o_custkey",
    "rules_all_documents": ALL_RULES_SQL, "rules_tables_gate": TABLE_GATE_SQL,
    "rpr_001_trailing_space": f"WITH {SPACED_SQL} SELECT doc_id, sha256({SP}) AS after, len(list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '[ \\t]$')))::BIGINT AS lines FROM s",
    "rpr_chain_replay_rollback": f"WITH {SPACED_SQL} SELECT doc_id, ({SP} <> markdown)::INT::BIGINT AS records, 0::BIGINT AS again, CASE WHEN {SP} <> markdown THEN true END AS replays, CASE WHEN {SP} <> markdown THEN true END AS undone FROM s",
    "rpr_aff_affected_blocks": f"WITH {SPACED_SQL} SELECT doc_id, 'QL-RPR-001' AS rule_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS l FROM s) WHERE regexp_matches(l, '[ \\t]$') GROUP BY doc_id",
    "set_03_resolved": f"WITH {SPACED_SQL}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS x, unnest(string_split({SP}, chr(10))) AS y, unnest(range(len(string_split(markdown, chr(10))))) AS pos FROM s), a AS (SELECT doc_id, CASE WHEN length(x) < 20 THEN 'short ' || pos ELSE 'blank end ' || pos END AS m FROM l WHERE regexp_matches(x, '[ \\t]$') OR length(x) < 20), b AS (SELECT doc_id, CASE WHEN length(y) < 20 THEN 'short ' || pos ELSE 'blank end ' || pos END AS m FROM l WHERE regexp_matches(y, '[ \\t]$') OR length(y) < 20) SELECT doc_id, count(*) AS n_resolved FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY doc_id",
    "rte_02_automatic": AUTO_SQL, "rte_03_manual": MANUAL_SQL, "rte_04_reparse": REPARSE_SQL,
    "rte_06_signals": "SELECT doc_id, ['.md', '.pdf', '', '.csv'][doc_id % 4 + 1] AS ext, strlen(text) AS size_bytes, CASE WHEN doc_id % 4 IN (0, 3) THEN true END AS has_text FROM documents",
    "rte_07_attempts": "WITH c AS (SELECT l_orderkey AS request_id, l_linenumber AS ord, NOT (bool_or(l_returnflag = 'R') OR bool_or(l_quantity < 10)) AS ok FROM lineitem GROUP BY ALL), a AS (SELECT request_id, min(ord) FILTER (ok) AS at_ord FROM c GROUP BY ALL) SELECT request_id, 'p' || at_ord AS selected, string_agg('p' || ord, ',' ORDER BY ord) AS attempts FROM c JOIN a USING (request_id) WHERE at_ord IS NULL OR ord <= at_ord GROUP BY request_id, at_ord",
    "str_01_reconcile": f"WITH {LIFE_SQL} SELECT kind, path, previous_path, source_id FROM ev",
    "str_01_state": f"WITH {LIFE_SQL}, s AS (SELECT CASE WHEN kind = 'deleted' THEN 'deleted' WHEN kind = 'unchanged' THEN 'active' ELSE 'active' END AS state FROM ev UNION ALL SELECT 'deleted' FROM old WHERE state = 'deleted') SELECT state, count(*) AS n FROM s GROUP BY state",
}

