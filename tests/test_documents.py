"""Hand-made saved documents, read as JSON, through repairs, all 22 rules and the gate."""

import json

import pytest

from lithoframe.operators import gate, repairs, tables
from lithoframe.sources import files


def block(i, kind, text, page=1, level=None, **more):
    return {"id": f"b{i}", "source_block_id": f"s{i}", "order_index": i, "kind": kind, "text": text, "markdown": more.pop("markdown", text), "heading_level": level, "anchor": {"page_number": page, "bbox": [10, 20 * i, 200, 20 * i + 15], "coordinate_system": "top_left_absolute", "bbox_granularity": "block"}, "metadata": more}


def cell(r, c, text, rs=1, cs=1, head=False, row=False):
    return {"text": text, "start_row": r, "start_col": c, "row_span": rs, "col_span": cs, "column_header": head, "row_header": row, "bbox": [c, r, c + cs, r + rs]}


def document(key, blocks, tables=(), capabilities=()):
    caps = {c: {"state": "available"} for c in ("page_bbox", "table_cells")} | dict(capabilities)
    return {"document_id": key, "source_sha256": key, "filename": f"{key}.pdf", "markdown": "\n\n".join(b["markdown"] for b in blocks), "blocks": blocks, "tables": list(tables), "assets": [], "native_artifacts": [], "capabilities": caps}


HEAD = [cell(0, 0, "item", 3, head=True), cell(0, 1, "buying", 1, 2, head=True), cell(0, 3, "service", 1, 2, head=True), cell(1, 1, "vendor", 1, 2, head=True), cell(1, 3, "warranty", 1, 2, head=True), cell(2, 1, "price", head=True), cell(2, 2, "days", head=True), cell(2, 3, "term", head=True), cell(2, 4, "reply", head=True)]
PIPE = "| item | price |\n| --- | --- |\n| A | 1 |"


def merged():
    """Three header rows with merged cells, two data rows with row headers."""
    body = [cell(r, c, f"{n}{c}" if c else n, row=c == 0) for r, n in ((3, "pump"), (4, "valve")) for c in range(5)]
    t = {"table_id": "t", "block_id": "b1", "markdown": PIPE, "num_rows": 5, "num_cols": 5, "header_rows": 3, "row_header_columns": [0], "page_number": 1, "bbox": [0, 0, 9, 9], "cells": HEAD + body, "metadata": {}}
    return document("merged", [block(0, "heading", "1 Offers", level=1), block(1, "table", "table", markdown=PIPE)], [t])


def cited():
    """Numbered headings on three levels, citations and a bibliography of six."""
    rows = [("heading", "1 Aim", 1), ("paragraph", "As shown [1], and later [2-4].", None), ("heading", "1.1 Method", 2), ("paragraph", "Others differ [5, 6].", None), ("heading", "1.1.1 Detail", 3), ("paragraph", "Nothing cited.", None), ("heading", "References", 1)]
    rows += [("reference", f"[{i}] Author {i}. Title {i}.", None) for i in range(1, 7)]
    return document("cited", [block(i, k, t, level=n) for i, (k, t, n) in enumerate(rows)])


def ambiguous():
    """One level for all headings, one without number, and a bibliography in which one number occurs twice."""
    rows = [("heading", "Overview", 2), ("heading", "1.2 Deep", 2), ("heading", "Loose end", 2), ("paragraph", "See [1].", None), ("heading", "References", 2), ("reference", "[1] Author. First.", None), ("reference", "[1] Author. Second.", None)]
    return document("ambiguous", [block(i, k, t, level=n) for i, (k, t, n) in enumerate(rows)])


def continued():
    """Two tables with equal headers on consecutive pages; the second says that it goes on. The third isn't like them."""
    def part(k, page, names, caption=None):
        cells = [cell(0, i, n, head=True) for i, n in enumerate(names)] + [cell(1, i, f"{k}{i}", row=i == 0) for i in range(len(names))]
        return {"table_id": f"t{k}", "block_id": f"b{k}", "caption": caption, "markdown": PIPE, "num_rows": 2, "num_cols": len(names), "header_rows": 1, "row_header_columns": [0], "page_number": page, "bbox": [0, 0, 9, 9], "cells": cells, "metadata": {}}

    return document("continued", [block(k, "table", "table", page=k + 1, markdown=PIPE) for k in range(3)], [part(0, 1, ["name", "size"]), part(1, 2, ["name", "size"], "Table 1 (continued)"), part(2, 3, ["other", "things", "here"])])


def poor():
    """No page evidence, broken characters and an HTML table that can be turned into pipes."""
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    blocks = [{"id": "b0", "kind": "paragraph", "text": "bad ������ text  ", "markdown": "bad ������ text  ", "order_index": 0}, {"id": "b1", "kind": "table", "text": "t", "markdown": html, "order_index": 1, "source_block_id": "s1"}]
    t = {"table_id": "t", "block_id": "b1", "html": html, "markdown": html, "cells": [cell(0, 0, "a"), cell(0, 1, "b"), cell(1, 0, "1"), cell(1, 1, "2")], "metadata": {}}
    return document("poor", blocks, [t], {"page_bbox": {"state": "unavailable", "reason": "saved text only"}})


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    for d in (merged(), cited(), ambiguous(), continued(), poor()):
        (root / f"{d['document_id']}.json").write_text(json.dumps(d))
    f = files.facts_of(files.read_parsed(spark, str(root)))
    r = gate.run_quality(f, repair=repairs.repair_all)
    return f, {k: [x.asDict() for x in r[k].collect()] for k in ("issues", "matrix", "gate", "relations", "bindings", "repairs")}, r["facts"]


def of(rows, doc, **want):
    return [x for x in rows if x["doc_id"] == doc and all(x[k] == v for k, v in want.items())]


def test_merged_headers_bind_by_full_paths(result):
    f, r, _ = result
    paths = {tuple(x.path) for x in tables.column_paths(tables.analysis(f), f.cells).filter("doc_id = 'merged'").collect()}
    assert paths == {("item",), ("buying", "vendor", "price"), ("buying", "vendor", "days"), ("service", "warranty", "term"), ("service", "warranty", "reply")}
    b = of(r["bindings"], "merged")
    assert {(x["row_key"], "/".join(x["column_path"]), x["value"]) for x in b} == {(n, p, f"{n}{c}") for n in ("pump", "valve") for c, p in enumerate(("buying/vendor/price", "buying/vendor/days", "service/warranty/term", "service/warranty/reply"), 1)}
    assert {x["state"] for x in b} == {"verified"} and not of(r["issues"], "merged", rule_id="QL-TBL-004")
    assert of(r["matrix"], "merged", capability="table_field_binding_reliable")[0]["state"] == "verified"


def test_headings_and_citations_are_related(result):
    _, r, _ = result
    rel = {(x["relation_type"], x["from_id"], x["to_id"], x["state"]) for x in of(r["relations"], "cited")}
    assert {x for x in rel if x[1] in ("b0", "b2")} == {("parent_child", "b0", "b2", "verified"), ("parent_child", "b2", "b4", "verified")}
    assert {(x[1], x[2]) for x in rel if x[0] != "parent_child"} == {("b1", f"b{6 + i}") for i in (1, 2, 3, 4)} | {("b3", "b12"), ("b3", "b11")}


def test_ambiguity_is_left_to_a_reviewer(result):
    _, r, _ = result
    assert not [x for x in of(r["relations"], "ambiguous") if x["relation_type"] != "parent_child"]
    assert of(r["matrix"], "ambiguous", capability="heading_tree_reliable")[0]["state"] == "manual_review_required"
    assert of(r["gate"], "ambiguous")[0]["state"] == "pass_with_warnings" and of(r["issues"], "ambiguous", rule_id="QL-HDG-004")


def test_continuation(result):
    _, r, _ = result
    found = [(x["from_id"], x["to_id"], x["state"]) for x in of(r["relations"], "continued", relation_type="table_continuation")]
    assert found == [("b0", "b1", "verified")]


def test_poor_documents_are_rejected_and_repaired(result):
    _, r, fixed = result
    g = of(r["gate"], "poor")[0]
    assert g["state"] == "rejected" and g["critical_issues"] >= 1
    assert len(of(r["issues"], "poor", category="evidence_availability")) == 7  # the order of blocks and boxes of tables need pages
    assert {(x["rule_id"], x["applied"]) for x in of(r["repairs"], "poor")} == {("QL-RPR-001", True), ("QL-RPR-003", True)}
    md = {x.doc_id: x.markdown for x in fixed.documents.collect()}["poor"]
    assert md == "bad ������ text\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert not [x for x in r["gate"] if x["state"] == "pass"]
