"""Packages, deliveries and payloads: what SQL can't show."""

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import packages
from lithoframe.sources import payloads, preflight


def test_a_batch_fails_on_dangling_references_and_rejected_documents(spark):
    selected = spark.createDataFrame([("d", "s", "p", "ab" * 32)], "doc_id string, source_id string, parser string, output_sha string")
    asset = spark.createDataFrame([("d", "img/a.png")], "doc_id string, path string")
    more = asset.union(spark.createDataFrame([("d", "img/b.png")], asset.schema))
    gate = lambda s: spark.createDataFrame([("d", s)], "doc_id string, state string")
    assert packages.materialise(selected, asset, asset, gate("pass")).first().asset_count == 1
    with pytest.raises(Exception, match="dangling references: img/b.png"):
        packages.materialise(selected, more, asset, gate("pass")).collect()
    for state in ("rejected", "reparse_required", None):
        with pytest.raises(Exception, match="was not accepted"):
            packages.materialise(selected, asset, asset, gate(state)).collect()


def test_broken_packages_are_found(spark, tmp_path):
    files = spark.createDataFrame([("d", n, "{}\n") for n in ("structure.json", "quality_issues.json", "parsed_document.json")] + [("e", "structure.json", "{")], "doc_id string, name string, content string").withColumn("sha256", F.sha2("content", 256))
    packages.write_packages(files.withColumn("sha256", F.when(F.col("name") == "quality_issues.json", "00").otherwise(F.col("sha256"))), str(tmp_path / "p"))
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "doc_id string")
    assert {r.doc_id: (r.files, r.bad) for r in packages.verify_packages(spark, str(tmp_path / "p"), docs).collect()} == {"d": (3, 1), "e": (1, 3), "f": (0, 3)}


def test_actions_may_be_repeated(spark):
    state = spark.createDataFrame([("a", "x", "active", 1), ("b", "y", "deleted", 2)], "source_id string, place string, state string, version int")
    act = spark.createDataFrame([("a", 1, "relocate", "z"), ("b", 1, "relocate", "z"), ("c", 1, "withdraw", None), ("d", 1, "publish", "n")], "source_id string, n int, action string, place string")
    once = packages.apply_actions(state, act)
    rows = {tuple(r) for r in once.collect()}
    assert rows == {("a", "z", "active", 2), ("b", "y", "deleted", 2), ("d", "n", "active", 1)}
    assert {tuple(r) for r in packages.apply_actions(once, act).collect()} == rows


def test_payloads_of_wrong_shape_give_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"tables": 5}'), (4, '{"tables": [null, {"cells": [{"row": "1", "col": 0}, {"row": 1, "col": 0, "bbox": [1, 2]}]}]}')], "doc_id int, payload string")
    t, c, g = payloads.payload_tables(payloads.read_payloads(df, "payload"), "doc_id")
    assert [(r.doc_id, r.table_id) for r in t.collect()] == [(4, "parser-table-0001")]
    assert [(r.cell_id, r.bbox) for r in c.collect()] == [("parser-table-0001:r1c0", None)] and g.count() == 0
    assert payloads.ocr_spans(payloads.read_payloads(df, "payload"), "doc_id").count() == 0


def test_native_results_become_facts(spark):
    payload = '{"tables": [{"table_id": "t", "source_block_id": "x", "cells": [{"row": 0, "col": 0, "text": "a"}]}]}'
    native = spark.createDataFrame([("m", "# T\n\ntext", None), ("p", "", payload)], "doc_id string, markdown string, payload string")
    none = lambda df: df.select("doc_id", F.lit(None).cast("string").alias("source_block_id"), F.lit(None).cast("int").alias("order_index"), F.lit("paragraph").alias("kind")).filter("1 = 0")
    f = payloads.normalised(native, none)
    assert sorted((r.doc_id, r.kind, r.position) for r in f.blocks.collect()) == [("m", "heading", 1), ("m", "paragraph", 2), ("p", "table", 1)]
    assert f.cells.first().cell_id == "t:r0c0" and f.tables.first().block_id == "x"


def test_lines_that_are_missing_or_broken_give_nothing(spark, tmp_path):
    assert preflight.read_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in preflight.read_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_damaged_files_are_findings(spark):
    for ext in (".pdf", ".docx", ".xlsx", ".doc"):
        for raw in (b"", b"PK\x03\x04", b"%PDF", b"\xd0\xcf"):
            assert preflight.examine(ext, raw)["is_corrupt"]
    assert preflight.examine(".pdf", None) is None and preflight.examine(None, b"x")["source_kind"] == ""
