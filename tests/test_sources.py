"""Sources on small inputs."""

import io
import json
import zipfile

from lithoframe.sources import files, html, markdown


def test_html_spans_nesting_and_muted_parts():
    cells = html.cells_of("<table><tr><th rowspan=2>a<script>no</script></th><td>b<td>c<tr><td colspan=2>d <table><tr><td>in</table></table>")
    got = [(c["depth"], c["start_row"], c["start_col"], c["text"]) for c in cells]
    assert got == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, "c"), (0, 1, 1, "d"), (1, 0, 0, "in")]
    assert cells[-1]["parent"] == 0
    assert [c["start_col"] for c in html.cells_of("<table><tr><td rowspan=2>a</td></tr><tr><td>b</td></tr></table>", occupied=False)] == [0, 0]
    assert html.cells_of(None) == [] and html.pipe("<p>none</p>") is None
    assert html.pipe("<table><tr><td>a|b<td>c</table>") == "| a\\|b | c |\n| --- | --- |"


def test_markdown_blocks(spark):
    md = "# Title\npara one\nstill\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n# code\n\nx\n```\n"
    b = markdown.blocks(spark.createDataFrame([(1, md), (2, ""), (3, None)], "doc_id int, markdown string")).orderBy("doc_id", "order_index").collect()
    assert [(r.kind, r.heading_level) for r in b] == [("heading", 1), ("paragraph", None), ("table", None), ("paragraph", None)]
    assert b[0].text == "Title" and b[1].text == "para one\nstill"


def test_workbook_cells(spark):
    buf = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"/></row><row r="2" hidden="1"><c r="A2"><f>1+1</f><v>2</v></c></row></sheetData><autoFilter ref="A1:A2"/></worksheet>')
    df = spark.createDataFrame([(1, bytearray(buf.getvalue())), (2, bytearray(b"junk")), (3, None)], "id int, content binary")
    got = [(r.id, r.cell_ref, r.value, r.value_type, r.formula, r.hidden, r.has_filter) for r in files.workbook_cells(df, "content", "id").collect()]
    assert got == [(1, "A1", "name", "string", None, False, True), (1, "A2", "2", "number", "1+1", True, True)]


def test_snapshot_and_parsed_documents(spark, tmp_path):
    (tmp_path / "in" / "skip").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("x")
    (tmp_path / "in" / "b.exe").write_text("x")
    (tmp_path / "in" / "skip" / "c.md").write_text("x")
    assert [r.path for r in files.snapshot(spark, str(tmp_path / "in"), ("skip",)).collect()] == ["a.md"]
    doc = {"document_id": "d", "markdown": "m", "blocks": [{"id": "b", "kind": "table", "metadata": {"marker": "[2]"}}], "tables": [{"table_id": "t", "block_id": "b", "cells": [{"text": "v", "start_row": 0, "start_col": 0}], "grid": [[{"kind": "origin", "cell_id": "t:r0c0"}]]}], "assets": [], "native_artifacts": [], "capabilities": {"page_bbox": {"state": "partial", "reason": "r"}}}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    f = files.facts_of(files.read_parsed(spark, str(tmp_path / "doc.json")))
    assert f.blocks.first().label == "[2]" and f.cells.first().row_span == 1 and f.capabilities.first().state == "partial" and f.grid.first().cell_id == "t:r0c0"


def test_payloads_sidecars_and_words(spark):
    p = spark.createDataFrame([(1, json.dumps([{"type": "Section-Header", "text": "T", "level": "2", "page": "3"}, {"kind": "table", "content": "c"}, {"md": "m"}]))], "id int, j string")
    assert [(r.kind, r.text, r.heading_level, r.page_number) for r in files.payload_blocks(p, "j", "id").collect()] == [("heading", "T", 2, 3), ("table", "c", None, None), ("paragraph", "m", None, None)]
    f = spark.createDataFrame([("o/x.md",), ("o/full.md",), ("o/a.png",), ("o/b.png",)], "path string")
    assert sorted(r.path for r in files.sidecar_files(f).collect()) == ["o/a.png", "o/b.png", "o/full.md"]
    w = spark.createDataFrame([(1, 10.0, 0.0, "big", 20.0), (1, 11.0, 5.0, "head", 20.0), (1, 30.0, 0.0, "small", 10.0), (1, 31.0, 9.0, "text", 10.0), (1, 50.0, 1.0, "x", 10.0)], "page int, top double, x0 double, text string, size double")
    assert [(r.text, r.kind) for r in files.lines_of_words(w, 3.0, "page").orderBy("line").collect()] == [("big head", "heading"), ("small text", "paragraph"), ("x", "paragraph")]
