"""Rules, gate, repairs and lifecycle on small hand-made inputs."""

import uuid

import pytest
from pyspark.sql import functions as F

from lithoframe.functions import exprs as x
from lithoframe.operators import audit, content, delivery, gate, lifecycle, repairs, routing, structure, tables, validation
from lithoframe.operators.model import ISSUES, Facts, last_blocks


def heads(spark, rows):
    """rows: (level, text[, order[, source]])"""
    b = [("d", f"b{i}", r[3] if len(r) > 3 else f"s{i}", r[2] if len(r) > 2 else i, "heading", r[1], r[0]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(b, "doc_id string, block_id string, source_block_id string, order_index int, kind string, text string, heading_level int")
    return Facts(spark.createDataFrame([("d", "x")], "doc_id string, markdown string"), df)


def relations(r):
    return sorted((a.from_id, a.to_id, a.state) for a in r.relations.collect())


def categories(r):
    return sorted(i.category for i in r.issues.collect())


def test_heading_tree(spark):
    r = structure.build_tree(heads(spark, [(1, "A"), (2, "B"), (3, "C"), (3, "D"), (2, "E")]))
    assert relations(r) == [("b0", "b1", "verified"), ("b0", "b4", "verified"), ("b1", "b2", "verified"), ("b1", "b3", "verified")]
    assert r.observations.first().state == "verified" and categories(r) == []


def test_level_jump_is_inferred(spark):
    r = structure.build_tree(heads(spark, [(1, "A"), (3, "B")]))
    assert relations(r) == [("b0", "b1", "inferred")] and categories(r) == ["heading_level_jump"]


def test_numbers_without_levels(spark):
    r = structure.build_tree(heads(spark, [(None, "1 A"), (None, "1.1 B"), (None, "1.2 C")]))
    assert relations(r) == [("b0", "b1", "inferred"), ("b0", "b2", "inferred")]


def test_orphan_degrades_later_relations_only(spark):
    r = structure.build_tree(heads(spark, [(1, "A"), (2, "B")]))
    assert relations(r) == [("b0", "b1", "verified")]
    r = structure.build_tree(heads(spark, [(3, "A"), (2, "B"), (3, "C")]))
    assert categories(r).count("heading_parent_missing") == 2 and relations(r) == [("b1", "b2", "manual_review_required")]


def test_uniform_levels_are_rebuilt_and_first_is_root(spark):
    r = structure.build_tree(heads(spark, [(2, "Title"), (2, "1 A"), (2, "1.1 B")]))
    assert "heading_level_granularity_suspect" in categories(r)


@pytest.mark.parametrize(("inner", "want"), [("1, 3, 5", [1, 3, 5]), ("2-4", [2, 3, 4]), ("5-2", None), ("1-1000", None), ("1，2", None), ("3,3", [3])])
def test_expand_marker(spark, inner, want):
    assert spark.range(1).select(x.expand_marker(F.lit(inner)).alias("e")).first().e == want


def cites(spark, body, entries):
    rows = [("d", f"p{i}", f"s{i}", i, "paragraph", t, None) for i, t in enumerate(body)] + [("d", "h", "sh", 100, "heading", "# References", 1)]
    rows += [("d", f"e{i}", f"t{i}", 101 + i, "reference", t, None) for i, t in enumerate(entries)]
    return Facts(spark.createDataFrame([("d", "x")], "doc_id string, markdown string"), spark.createDataFrame(rows, "doc_id string, block_id string, source_block_id string, order_index int, kind string, text string, heading_level int"))


def test_citations(spark):
    r = structure.bind_citations(cites(spark, ["see [1-2]", "[1](url) ![2](u)", "x [9]"], ["[1] one", "[2] two"]))
    assert relations(r) == [("p0", "e0", "verified"), ("p0", "e1", "verified")] and categories(r) == ["citation_binding"]
    r = structure.bind_citations(cites(spark, ["see [1]"], ["[1] one", "[1] other"]))
    assert relations(r) == [] and categories(r) == ["ambiguous_target"]


def test_unlabelled_entries_count_on(spark):
    f = cites(spark, [], ["first", "2. second", "third"])
    assert sorted(r.key for r in structure.reference_index(structure.reference_blocks(f.blocks)).collect()) == ["1", "2", "3"]


def grid(spark, cells, **table):
    """cells: (row, col, text, rs, cs, column_header, row_header)"""
    c = [("d", "t", f"t:{r}.{k}.{i}", r, k, rs, cs, s, ch, rh) for i, (r, k, s, rs, cs, ch, rh) in enumerate(cells)]
    t = {"doc_id": "d", "table_id": "t", "block_id": "b", **table}
    schema = "doc_id string, table_id string, block_id string" + "".join(f", {k} {'array<int>' if isinstance(v, list) else 'string' if isinstance(v, str) else 'int'}" for k, v in table.items())
    b = spark.createDataFrame([("d", "b", "s", 0, "table")], "doc_id string, block_id string, source_block_id string, order_index int, kind string")
    return Facts(spark.createDataFrame([("d", "x")], "doc_id string, markdown string"), b, spark.createDataFrame([tuple(t.values())], schema), spark.createDataFrame(c, "doc_id string, table_id string, cell_id string, start_row int, start_col int, row_span int, col_span int, text string, column_header boolean, row_header boolean"))


H = True


def test_two_level_header_and_bindings(spark):
    f = grid(spark, [(0, 0, "supplier", 2, 1, H, False), (0, 1, "2023", 1, 2, H, False), (1, 1, "q1", 1, 1, H, False), (1, 2, "q2", 1, 1, H, False), (2, 0, "acme", 1, 1, False, H), (2, 1, "5", 1, 1, False, False), (2, 2, "7", 1, 1, False, False)], num_rows=3, num_cols=3, header_rows=2)
    b = sorted((r.row_key, r.column_path, r.value, r.state) for r in tables.bindings(f).collect())
    assert b == [("acme", ["2023", "q1"], "5", "verified"), ("acme", ["2023", "q2"], "7", "verified")]


def test_hole_conflict_and_overflow(spark):
    a = tables.analysis(grid(spark, [(0, 0, "a", 1, 1, H, False), (0, 1, "b", 1, 1, H, False), (1, 0, "1", 1, 1, False, False)], num_rows=2, num_cols=2)).first()
    assert (a.n_holes, a.valid) == (1, False)
    a = tables.analysis(grid(spark, [(0, 0, "a", 1, 2, H, False), (0, 1, "b", 1, 1, H, False)], num_rows=1, num_cols=2)).first()
    assert (a.n_conflict, a.valid) == (1, False)
    assert tables.analysis(grid(spark, [(0, 0, "a", 3, 1, H, False)], num_rows=1, num_cols=1)).first().n_overflow == 1


def test_repeated_row_keys_are_manual(spark):
    cells = [(0, 0, "k", 1, 1, H, False), (0, 1, "v", 1, 1, H, False)] + [(r, c, t, 1, 1, False, c == 0) for r in (1, 2) for c, t in enumerate(("same", str(r)))]
    r = tables.binding_rule(grid(spark, cells, num_rows=3, num_cols=2, header_rows=1))
    assert {b.state for b in r.bindings.collect()} == {"manual_review_required"} and any(i.rule_id == "QL-TBL-005" for i in r.issues.collect())


def test_merged_row_header_is_inherited(spark):
    cells = [(0, 0, "k", 1, 1, H, False), (0, 1, "v", 1, 1, H, False), (1, 0, "m", 2, 1, False, H), (1, 1, "1", 1, 1, False, False), (2, 1, "2", 1, 1, False, False)]
    k = tables.row_keys(tables.analysis(grid(spark, cells, num_rows=3, num_cols=2, header_rows=1, row_header_columns=[0])), grid(spark, cells).cells).collect()
    assert sorted((r.start_row, r.row_key, r.repeated) for r in k) == [(1, "m", True), (2, "m", True)]


def verdicts(spark, rows):
    return spark.createDataFrame([("d", c, s, True, b, 0) for c, s, b in rows], "doc_id string, capability string, state string, applicable boolean, blocking boolean, n_refs int")


def drafts(spark, rows):
    return spark.createDataFrame([("d", "QL-X-001", "c", st, sev, f"m{i}", []) for i, (sev, st) in enumerate(rows)], ISSUES)


@pytest.mark.parametrize(("issues", "caps", "options", "state"), [
    ([], [("a", "verified", False)], {}, "pass"),
    ([("info", "open")], [], {}, "pass"),
    ([("info", "open")], [], {"info_blocks": True}, "pass_with_warnings"),
    ([("warning", "open")], [], {}, "pass_with_warnings"),
    ([("warning", "open")], [], {"warn": False}, "pass"),
    ([("critical", "open")], [], {}, "rejected"),
    ([("critical", "open")], [], {"critical_state": "reparse_required"}, "rejected"),
    ([("info", "reparse_required")], [], {}, "rejected"),
    ([("info", "manual_review_required")], [], {}, "pass_with_warnings"),
    ([], [("a", "inferred", False)], {}, "pass_with_warnings"),
    ([], [("a", "rejected", True)], {}, "rejected"),
    ([], [("a", "rejected", False)], {}, "pass"),
])
def test_gate(spark, issues, caps, options, state):
    d = spark.createDataFrame([("d",)], "doc_id string")
    assert gate.decide(d, drafts(spark, issues), verdicts(spark, caps), **options).first().state == state


def test_gate_can_ask_for_another_parse(spark):
    d = spark.createDataFrame([("d",)], "doc_id string")
    r = gate.decide(d, drafts(spark, [("critical", "open")]), verdicts(spark, []), critical_state="reparse_required", recommended=d).first()
    assert (r.state, r.reparse_issues) == ("reparse_required", 1)
    with pytest.raises(ValueError, match="critical_state"):
        gate.decide(d, drafts(spark, []), verdicts(spark, []), critical_state="pass")


def test_verified_without_references_is_inferred(spark):
    f = heads(spark, [(1, "A")])
    o = spark.createDataFrame([("d", "content_complete", "verified", []), ("d", "provenance_reliable", "verified", ["r"])], "doc_id string, capability string, state string, refs array<string>")
    m = {r.capability: (r.state, r.blocking) for r in gate.capability_matrix(f, o).collect()}
    assert m["content_complete"] == ("inferred", True) and m["provenance_reliable"] == ("verified", False) and m["table_grid_reliable"] == ("unavailable", False) and len(m) == 9


def test_all_rules_over_one_document(spark):
    r = gate.run_quality(heads(spark, [(1, "A"), (2, "B")]), repair=repairs.repair_all)
    # without page evidence five rules are skipped, and nothing passes outright
    assert r["issues"].filter("category = 'evidence_availability'").count() == 5
    assert r["gate"].first().state == "pass_with_warnings"


@pytest.mark.parametrize(("md", "want"), [
    ("| a | b |\n|---|\n", "| a | b |\n|---|---|\n"), ("| a |\n|:-:|---|\r\n| 1 |", "| a |\n|:-:|\r\n| 1 |"), ("```\n| a | b |\n|---|\n```", "```\n| a | b |\n|---|\n```"), ("| a\\|b |\n|---|\n", "| a\\|b |\n|---|\n"), (None, None), ("", ""),
])
def test_align_separators(md, want):
    assert repairs.align_separators(md) == want and repairs.align_separators(want) == want


def test_text_repairs_replay_and_roll_back(spark):
    d = spark.createDataFrame([("a", "x \t\r\ny  \n\n z"), ("b", "clean")], "doc_id string, markdown string")
    fixed, rec = repairs.repair_text(d)
    assert fixed.filter("doc_id = 'a'").first().markdown == "x\r\ny\n\n z"
    assert repairs.repair_text(fixed)[1].count() == 0 and rec.count() == 1
    assert repairs.replay(rec).first().ok and repairs.rollback(fixed, rec).first().undone
    assert not repairs.rollback(d, rec).first().undone


def test_line_breaks_come_back(spark):
    docs = spark.createDataFrame([("d", "p\n| a b |\n| --- |\nq")], "doc_id string, markdown string")
    b = spark.createDataFrame([("d", "b", "table", "| a b |\n| --- |")], "doc_id string, block_id string, kind string, markdown string")
    t = spark.createDataFrame([("d", "t", "b", "| a b |\n| --- |", "anchor_copy")], "doc_id string, table_id string, block_id string, markdown string, markdown_rendering string")
    c = spark.createDataFrame([("d", "t", "c", 0, 0, 1, 1, "a b", "a\r\nb", "string")], "doc_id string, table_id string, cell_id string, start_row int, start_col int, row_span int, col_span int, text string, raw_value string, value_type string")
    g = spark.createDataFrame([("d", "t", 0, 0, "origin", "c")], "doc_id string, table_id string, r int, c int, kind string, cell_id string")
    fixed, rec = repairs.restore_line_breaks(Facts(docs, b, t, c, g))
    assert fixed.documents.first().markdown == "p\n| a<br>b |\n| --- |\nq" and rec.first().applied


def test_the_block_written_last_counts(spark):
    rows = [("d", "b", 0, "table", "first"), ("d", "b", 2, "paragraph", "last"), ("d", "b", 1, "table", "middle"), ("d", "x", None, "table", "one")]
    for order in (rows, rows[::-1]):
        b = spark.createDataFrame(order, "doc_id string, block_id string, position int, kind string, markdown string")
        f = Facts(spark.createDataFrame([("d", "m")], "doc_id string, markdown string"), b)
        assert {tuple(r) for r in last_blocks(f.blocks, kind="kind", md="markdown").collect()} == {("d", "b", "paragraph", "last"), ("d", "x", "table", "one")}


def test_all_four_repairs_and_their_rejections(spark):
    html = "<table><tr><td>a</td></tr></table>"
    docs = spark.createDataFrame([("d", f"head  \n{html}\n| x y |\n| --- |\n| p | q |\n|---|\nend")], "doc_id string, markdown string")
    b = spark.createDataFrame([("d", "h", "table", html), ("d", "x", "table", "| x y |\n| --- |"), ("d", "p", "paragraph", "<table></table>")], "doc_id string, block_id string, kind string, markdown string")
    t = spark.createDataFrame([("d", "th", "h", html, html, None), ("d", "tx", "x", None, "| x y |\n| --- |", "anchor_copy"), ("d", "tp", "p", "<table><tr><td>z</td></tr></table>", "", None)], "doc_id string, table_id string, block_id string, html string, markdown string, markdown_rendering string")
    c = spark.createDataFrame([("d", "tx", "c", 0, 0, 1, 1, "x y", "x\ny", "string")], "doc_id string, table_id string, cell_id string, start_row int, start_col int, row_span int, col_span int, text string, raw_value string, value_type string")
    g = spark.createDataFrame([("d", "tx", 0, 0, "origin", "c")], "doc_id string, table_id string, r int, c int, kind string, cell_id string")
    fixed, rec = repairs.repair_all(Facts(docs, b, t, c, g))
    assert fixed.documents.first().markdown == "head\n| a |\n| --- |\n| x<br>y |\n| --- |\n| p | q |\n|---|---|\nend"
    assert {(r.rule_id, r.object_id, r.applied) for r in rec.collect()} == {("QL-RPR-001", "markdown", True), ("QL-RPR-002", "markdown", True), ("QL-RPR-003", "th", True), ("QL-RPR-003", "tp", False), ("QL-RPR-004", "tx", True)}
    assert {r.table_id: r.markdown for r in fixed.tables.collect()} == {"th": "| a |\n| --- |", "tx": "| x<br>y |\n| --- |", "tp": ""}
    r = gate.run_quality(Facts(docs, b, t, c, g), repair=repairs.repair_all)
    assert [x.message for x in r["issues"].filter("category = 'repair_rejected'").collect()] == ["QL-RPR-003 not applied to tp: no table block"]


def test_scenarios_and_ratings(spark):
    src = spark.createDataFrame([(".pdf", 0.9, 1, 2, "other", 1, 5, [1, 3, 3], 250)], "ext string, scanned double, images int, media int, category string, tables int, cells int, detected array<int>, pages int")
    no = F.lit(False)
    tags = audit.scenarios(F.col("ext"), F.col("scanned"), F.col("images"), F.col("tables"), F.col("cells"), F.col("pages"), no, no, no, F.lit(0), no, F.col("media"), F.col("category"), F.col("detected"))
    assert src.select(tags.alias("t")).first().t == ["complex_table", "format_pdf", "image_rich", "scanned_ocr_pdf", "very_long_document"]
    rec = {"ext": ".pdf", "scenarios": ["complex_table", "image_rich", "scanned_ocr_pdf"], "source_pages": 10, "parser_success": True, "is_empty": False, "proxy_available": True, "coverage": 0.85, "order_score": 0.7, "length_ratio": 2.0, "page_coverage": 0.0,
           "table_count": 2, "table_cells": 0, "html_tables": 0, "pipe_rows": 0, "references": 2, "missing_references": 1, "assets": 0, "pictures": 0, "headings": 1, "blocks": 3, "chars": 50}
    ddl = "ext string, scenarios array<string>, source_pages int, parser_success boolean, is_empty boolean, proxy_available boolean, coverage double, order_score double, length_ratio double, page_coverage double, table_count int, table_cells int, html_tables int, pipe_rows int, references int, missing_references int, assets int, pictures int, headings int, blocks int, chars int"
    rate = lambda **x: audit.capability_ratings(spark.createDataFrame([tuple((rec | x).values())], ddl)).first().ratings.asDict()
    assert list(rate().values()) == ["partial", "partial", "failed", "partial", "partial", "partial", "partial"]
    assert set(rate(parser_success=False).values()) == {"failed"}
    assert list(rate(parser_success=False, ext=".xls", scenarios=[]).values()) == ["failed", "failed", "not_applicable", "not_applicable", "not_applicable", "failed", "not_applicable"]
    good = rate(length_ratio=1.0, order_score=0.95, page_coverage=0.96, table_cells=3, pipe_rows=1, missing_references=0, headings=2)
    assert list(good.values()) == ["good"] * 6 + ["partial"]
    assert list(rate(proxy_available=False, source_pages=None, scenarios=[], blocks=0).values()) == ["not_applicable"] * 5 + ["failed", "not_applicable"]


def test_uuid5(spark):
    for key in ("", "block|x|1", "标题|é"):
        got = spark.range(1).select(x.uuid5(F.lit(key)).alias("u")).first().u
        assert got == str(uuid.uuid5(uuid.UUID(x.QUALITY_NAMESPACE), key))


def test_lifecycle(spark):
    state = spark.createDataFrame([("1", "a", "s1", "active"), ("2", "b", "s2", "active"), ("3", "c", "s3", "parse_failed"), ("4", "gone", "s9", "active"), ("5", "old", "s4", "active"), ("6", "dead", "s8", "deleted")], lifecycle.STATE)
    snap = spark.createDataFrame([("a", "s1"), ("b", "new"), ("c", "s3"), ("moved", "s4"), ("dead", "s8")], "path string, sha256 string")
    e = lifecycle.reconcile(state, snap)
    assert sorted((r.kind, r.path) for r in e.collect()) == [("added", "dead"), ("deleted", "gone"), ("modified", "b"), ("moved", "moved"), ("retry", "c"), ("unchanged", "a")]
    failed = spark.createDataFrame([("2",)], "source_id string")
    s = {r.source_id: (r.path, r.state) for r in lifecycle.next_state(state, e, failed).collect()}
    assert s["2"] == ("b", "parse_failed") and s["5"] == ("moved", "active") and s["4"] == ("gone", "deleted") and s["1"] == ("a", "active")


def test_streamed_scans(spark, tmp_path):
    from lithoframe.streaming import reconcile

    src, root = tmp_path / "scans", tmp_path / "out"
    for i, rows in enumerate([[("a", "1"), ("b", "2")], [("a", "1"), ("c", "2")]]):
        spark.createDataFrame(rows, "path string, sha256 string").coalesce(1).write.mode("append").json(str(src))
        q = reconcile.start(spark.readStream.schema("path string, sha256 string").json(str(src)), str(root), str(tmp_path / "cp"))
        q.awaitTermination(120)
        kinds = sorted(r.kind for r in spark.read.parquet(f"{root}/events/batch={i}").collect())
        assert kinds == (["added", "added"] if i == 0 else ["moved", "unchanged"])


def test_routing_guards(spark):
    reg = routing.registry(spark)
    r = spark.createDataFrame([(1, ".pdf", "mineru", False), (2, ".csv", "mineru", True), (3, ".pdf", "ocr", True), (4, ".pdf", "docling", False), (5, ".pdf", "nobody", True)], "request_id int, ext string, parser_id string, allow_cloud boolean")
    assert [x.error for x in routing.manual(r, reg).orderBy("request_id").collect()] == ["cloud forbidden", "format not supported", "no OCR engine", None, "unknown parser"]


def test_documents_are_checked(spark):
    f = Facts(spark.createDataFrame([("d", "x")], "doc_id string, markdown string"), spark.createDataFrame([("d", "b", "paragraph"), ("d", "b", "paragraph")], "doc_id string, block_id string, kind string"), spark.createDataFrame([("d", "t", "b"), ("d", "u", "none")], "doc_id string, table_id string, block_id string"), assets=spark.createDataFrame([("d", "../x")], "doc_id string, path string"))
    assert sorted({e.code for e in validation.document_errors(f).collect()}) == ["block_is_no_table", "duplicate_block", "table_without_block", "unsafe_path"]


def test_mojibake_and_data_uris(spark):
    f = Facts(spark.createDataFrame([("a", "Ã©Ã¨"), ("b", "\x01"), ("c", "fine\t\n"), ("e", "![x](data:image/png;base64,AA)")], "doc_id string, markdown string"))
    assert sorted(r.doc_id for r in content.mojibake(f).issues.collect()) == ["a", "b"]
    assert [r.doc_id for r in content.data_uri(f).issues.collect()] == ["e"]


def test_table_index_round_trip(spark, tmp_path):
    f = grid(spark, [(0, 0, "a", 1, 1, H, False), (0, 1, "b", 1, 1, H, False), (1, 0, "k", 1, 1, False, H), (1, 1, "v w", 1, 1, False, False)], num_rows=2, num_cols=2, header_rows=1)
    delivery.write_table_index(f, tables.bindings(f), str(tmp_path))
    assert {r["name"]: (r.n, r.dangling) for r in delivery.verify_table_index(spark, str(tmp_path)).collect()} == {"document_tables": (1, 0), "table_cells": (4, 0), "field_bindings": (1, 0), "cell_search": (5, 0)}
    assert '"value":"v w"' in delivery.structure_json(f, tables.bindings(f)).first().json
