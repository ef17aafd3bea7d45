"""The facts that rules read and the tables that they write."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: states, in the order in which the worst is kept
RANK = {"verified": 1, "unavailable": 2, "inferred": 3, "manual_review_required": 4, "reparse_required": 5, "rejected": 6}
VERIFIED, UNAVAILABLE, INFERRED, MANUAL, REPARSE, REJECTED = RANK
CRITICAL, WARNING, INFO = "critical", "warning", "info"
OPEN = "open"

ISSUES = "doc_id string, rule_id string, category string, status string, severity string, message string, blocks array<string>"
OBSERVATIONS = "doc_id string, capability string, state string, refs array<string>"
RELATIONS = "doc_id string, relation_type string, from_id string, to_id string, state string, marker_key string"

SCHEMAS = {
    "documents": "doc_id string, markdown string",
    "blocks": "doc_id string, block_id string, source_block_id string, order_index int, kind string, text string, markdown string, heading_level int, bbox array<double>, coordinate_system string, bbox_granularity string, page_number int, label string, position int",
    "tables": "doc_id string, table_id string, block_id string, num_rows int, num_cols int, header_rows int, row_header_columns array<int>, page_number int, bbox array<double>, caption string, html string, markdown string, structure_source string, view_scope string, source_row_count int, emitted_row_count int, hidden_row_count int, parent_table_id string, parent_cell_id string, nesting_depth int, markdown_rendering string",
    "cells": "doc_id string, table_id string, cell_id string, start_row int, start_col int, row_span int, col_span int, text string, raw_value string, value_type string, column_header boolean, row_header boolean, bbox array<double>, locator string",
    "grid": "doc_id string, table_id string, r int, c int, kind string, cell_id string",
    "assets": "doc_id string, path string, sha256 string",
    "artifacts": "doc_id string, artifact_id string, sha256 string, required boolean",
    "capabilities": "doc_id string, name string, state string, reason string",
}


@dataclass
class Facts:
    """Flat tables keyed by doc_id; a missing one is empty. buckets: if set, tables and cells lie in so many buckets by table_id."""

    documents: DataFrame
    blocks: DataFrame | None = None
    tables: DataFrame | None = None
    cells: DataFrame | None = None
    grid: DataFrame | None = None
    assets: DataFrame | None = None
    artifacts: DataFrame | None = None
    capabilities: DataFrame | None = None
    buckets: int | None = None
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        spark = self.documents.sparkSession
        for name, ddl in SCHEMAS.items():
            df = getattr(self, name)
            setattr(self, name, spark.createDataFrame([], ddl) if df is None else conform(df, ddl))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of a schema, missing ones null."""
    want = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


class Result(NamedTuple):
    issues: DataFrame | None = None
    observations: DataFrame | None = None
    relations: DataFrame | None = None
    bindings: DataFrame | None = None


def last_blocks(blocks: DataFrame, **columns: Column | str) -> DataFrame:
    """(doc_id, block_id, columns): one block of each id, the one written last.

    That is the one of the greatest position, then order_index; among blocks that neither tells apart the greatest values.
    """
    of = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])
    return blocks.groupBy("doc_id", "block_id").agg(F.max_by(of, F.struct(F.coalesce("position", F.lit(-1)), F.coalesce("order_index", F.lit(-1)), of)).alias("_b")).select("doc_id", "block_id", "_b.*")


def issue(df: DataFrame, rule_id: str, severity: str | Column, category: str, message: Column, blocks: Column | None = None, status: str = OPEN) -> DataFrame:
    """A row of df becomes an issue."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("doc_id", F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), F.lit(status).alias("status"), sev.alias("severity"), message.alias("message"), (F.array().cast("array<string>") if blocks is None else blocks).alias("blocks"))


def observe(df: DataFrame, capability: str, state: Column, refs: Column | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(capability).alias("capability"), state.alias("state"), (F.array().cast("array<string>") if refs is None else refs).alias("refs"))


def union(*parts: DataFrame | None) -> DataFrame:
    some = [p for p in parts if p is not None]
    out = some[0]
    for p in some[1:]:
        out = out.unionByName(p)
    return out


def worst(state: Column) -> Column:
    """The worst state of a group."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), state)
    return F.max_by(state, rank)
