"""HTML tables to cells and to pipe Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = {"script", "style", "template", "svg"}
CELL = "table_no int, depth int, parent int, start_row int, start_col int, row_span int, col_span int, header boolean, text string"


def _span(value: str | None) -> int:
    return max(1, int(value)) if value and value.strip().isdigit() else 1


class TableScan(HTMLParser):
    """Collects the rows of every table, nested ones by themselves; unclosed cells and rows end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        if tag in IGNORED:
            self.muted += 1
        if self.muted:
            return
        if tag == "table":
            t = {"rows": [], "cell": None, "depth": len(self.open), "parent": self.tables.index(self.open[-1]) if self.open else None}
            self.tables.append(t)
            self.open.append(t)
        elif self.open:
            t, a = self.open[-1], dict(attrs)
            if tag == "tr":
                t["cell"] = None
                t["rows"].append([])
            elif tag in ("td", "th"):
                if not t["rows"]:
                    t["rows"].append([])
                t["cell"] = {"text": [], "rs": _span(a.get("rowspan")), "cs": _span(a.get("colspan")), "head": tag == "th"}
                t["rows"][-1].append(t["cell"])
            elif tag in ("br", "p", "li") and t["cell"] is not None:
                t["cell"]["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in IGNORED:
            self.muted = max(0, self.muted - 1)
        elif self.open and not self.muted:
            if tag == "table":
                self.open.pop()
            elif tag in ("td", "th", "tr"):
                self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and not self.muted and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"]["text"].append(data)


def place(rows: list[list[dict]], occupied: bool = True) -> list[tuple[int, int, dict]]:
    """(row, column, cell): each cell in the next free column; without `occupied`, row spans above don't shift it."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while occupied and (r, c) in taken:
                c += 1
            out.append((r, c, cell))
            taken.update((y, z) for y in range(r, r + cell["rs"]) for z in range(c, c + cell["cs"]))
            c += cell["cs"]
    return out


def text_of(cell: dict) -> str:
    return re.sub(r"\s+", " ", "".join(cell["text"]).replace("\xa0", " ")).strip()


def scan(html: str | None) -> list[dict]:
    p = TableScan()
    p.feed(html or "")
    p.close()
    return p.tables


def cells_of(html: str | None, occupied: bool = True) -> list[dict]:
    return [{"table_no": k, "depth": t["depth"], "parent": t["parent"], "start_row": r, "start_col": c, "row_span": x["rs"], "col_span": x["cs"], "header": x["head"], "text": text_of(x)} for k, t in enumerate(scan(html)) for r, c, x in place(t["rows"], occupied)]


def pipe(html: str | None) -> str | None:
    """The first table as pipe Markdown, covered slots repeating their cell; None without cells or with nested tables."""
    tables = scan(html)
    if len(tables) != 1 or not any(tables[0]["rows"]):
        return None
    placed = place(tables[0]["rows"])
    height, width = max(r + x["rs"] for r, _, x in placed), max(c + x["cs"] for _, c, x in placed)
    grid = [[""] * width for _ in range(height)]
    for r, c, x in placed:
        for y in range(r, r + x["rs"]):
            for z in range(c, c + x["cs"]):
                grid[y][z] = text_of(x).replace("|", "\\|")
    lines = ["| " + " | ".join(row) + " |" for row in grid]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def html_cells(df: DataFrame, html_col: str, *keys: str, occupied: bool = True) -> DataFrame:
    """A row per cell of every table in html_col; header_cell marks the first row, row_header a th in the first column."""
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in CELL.split(", ")]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cells_of(t, occupied) for t in texts.to_pylist()], pa.list_(pa.struct([(n, kinds[k]) for n, k in fields])))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    cells = F.arrow_udf(run, "array<struct<" + ",".join(f"{n}:{k}" for n, k in fields) + ">>")
    e = df.select(*keys, F.explode(cells(html_col)).alias("_c")).select(*keys, "_c.*")
    return e.withColumns({"column_header": F.col("start_row") == 0, "row_header": F.col("header") & (F.col("start_col") == 0) & (F.col("start_row") > 0)})


def html_pipe(html: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([pipe(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(html)
