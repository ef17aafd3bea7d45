"""Tables: grid analysis, column paths, field bindings, evidence, representation and continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.functions.exprs import blank, escape_cell, strip
from lithoframe.functions.session import bucketed, dealt, materialized, near
from lithoframe.operators.content import text
from lithoframe.operators.model import INFERRED, MANUAL, VERIFIED, WARNING, Facts, Result, issue, last_blocks, observe, union
from lithoframe.operators.structure import order_conflicts

KEY = ["doc_id", "table_id"]
EXTERNAL_CELLS = 50_000
CONTINUATION = r"(?i)续|continued|continuation|cont\."  # fixed value: words that announce a continued table
DRIFT = 0.12


def identified(cells: DataFrame) -> DataFrame:
    """Cells with their id, by default table:r{row}c{col}."""
    return cells.withColumn("cell_id", F.coalesce(F.nullif("cell_id", F.lit("")), text(F.col("table_id"), ":r", F.col("start_row"), "c", F.col("start_col"))))


def slots(cells: DataFrame) -> DataFrame:
    """A row for each slot that a cell covers (spans exploded, so that coverage joins are equi-joins)."""
    r = F.sequence("start_row", F.col("start_row") + F.greatest("row_span", F.lit(1)) - 1)
    c = F.sequence("start_col", F.col("start_col") + F.greatest("col_span", F.lit(1)) - 1)
    return cells.withColumn("r", F.explode(r)).withColumn("c", F.explode(c))


def _run(rows: Column, start: Column, good) -> Column:
    """How many rows in a row, from number `start` on, are there and good; rows: structs in the order of start_row, each once."""
    step = lambda a, x: a + F.when((x["start_row"] == start + a) & F.coalesce(good(x), F.lit(False)), 1).otherwise(0)
    return F.aggregate(F.coalesce(rows, F.array().cast(ROWS)), F.lit(0), step)


def _at(rows: Column, number: Column, field: str) -> Column:
    """A flag of the row of that number, false where there is none."""
    return F.exists(F.coalesce(rows, F.array().cast(ROWS)), lambda x: (x["start_row"] == number) & F.coalesce(x[field], F.lit(False)))


ROWS = "array<struct<start_row:int,full:boolean,span:boolean,wide:boolean,head:boolean,mark:boolean,filled:bigint,digits:bigint>>"


def held(df: DataFrame, n: int | None) -> DataFrame:
    """df as the side of a join that is hashed, if tables lie in n buckets: a bucket's part of it is small, and cells needn't be sorted."""
    return df.hint("shuffle_hash") if n else df


def grid_analysis(tables: DataFrame, cells: DataFrame, grid: DataFrame, n: int | None = None) -> DataFrame:
    """A row per table: declared size, header rows, title rows, row-header columns, counts of defects, valid.

    Cells meet their table once and stay dealt out by table: what follows needs no other exchange of cells. Where tables
    and cells lie in n buckets they are read from there each time, without an exchange and without being kept.
    """
    cells = identified(cells)
    place = (lambda df, *_: df) if n else dealt
    c = place(cells.select(*KEY, "cell_id", "start_row", "start_col", "row_span", "col_span", "column_header", "row_header", blank(F.col("text")).alias("blank"), F.col("text").rlike(r"(?U)\d").alias("digits")), *KEY)
    t = place(tables, *KEY)
    end_row, end_col = F.col("start_row") + F.col("row_span"), F.col("start_col") + F.col("col_span")
    # an axis without a declared size reaches as far as its cells, so nothing leaves it
    cj = c.join(held(t.select(*KEY, "num_rows", "num_cols"), n), KEY, "left")
    per = cj.groupBy(*KEY).agg(
        F.count("*").alias("n_cells"), F.max(end_row).alias("max_row"), F.max(end_col).alias("max_col"), F.count_if((F.col("start_row") < 0) | (F.col("start_col") < 0)).alias("n_negative"),
        F.count_if((end_row > F.col("num_rows")) | (end_col > F.col("num_cols"))).alias("n_overflow"), F.array_sort(F.collect_set(F.when(F.col("column_header"), F.col("start_row")))).alias("marked"),
    )
    ids = c.groupBy(*KEY, "cell_id").agg((F.count("*") - 1).alias("k")).groupBy(*KEY).agg(F.sum("k").alias("n_duplicate"))
    widest = c.groupBy(*KEY).agg(F.max(end_col).alias("max_col"))
    by_row = cj.join(held(widest, n), KEY).filter("start_row >= 0").groupBy(*KEY, "start_row").agg(
        F.bool_or((F.col("start_col") == 0) & (F.col("col_span") == F.coalesce("num_cols", "max_col"))).alias("full"), F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("span"),
        F.bool_or(F.col("col_span") > 1).alias("wide"), F.bool_or(F.coalesce("row_header", F.lit(False))).alias("head"), F.bool_or(F.coalesce("column_header", F.lit(False))).alias("mark"),
        F.count_if(~F.col("blank")).alias("filled"), F.count_if("digits").alias("digits"),
    )
    by_row = by_row.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start_row", "full", "span", "wide", "head", "mark", "filled", "digits"))).alias("by_row"))
    s = slots(c.select(*KEY, "start_row", "start_col", "row_span", "col_span")).groupBy(*KEY, "r", "c").agg(F.count("*").alias("k"))
    taken = s.groupBy(*KEY).agg(F.sum(F.col("k") - 1).alias("n_conflict"))
    t = t.join(per, KEY, "left").withColumns({"rows": F.coalesce("num_rows", "max_row", F.lit(0)), "cols": F.coalesce("num_cols", "max_col", F.lit(0))})
    t = t.join(ids, KEY, "left").join(by_row, KEY, "left").join(taken, KEY, "left")
    rows = F.col("by_row")
    prose = lambda x: (x["filled"] > 0) & (x["digits"] == 0)
    within = F.filter(F.coalesce(rows, F.array().cast(ROWS)), lambda x: x["start_row"] < F.col("rows"))
    t = t.withColumn("by_row", within).withColumns({"n_marked": _run(rows, F.lit(0), lambda x: x["mark"]), "n_title": _run(rows, F.lit(0), lambda x: x["full"])})
    first_wide = _at(rows, F.lit(0), "wide")
    below = _run(rows, F.col("n_marked"), lambda x: prose(x) & ~x["head"])
    anchored = _at(rows, F.col("n_title"), "span")
    spanned = _run(rows, F.col("n_title"), lambda x: x["span"] | prose(x))
    some = F.col("n_cells").isNotNull()  # a table without cells has nothing but that defect
    given = some & F.coalesce(F.col("header_rows") > 0, F.lit(False))
    has_marks = F.coalesce(F.size("marked") > 0, F.lit(False))
    run = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    t = t.withColumns({
        "n_below": F.when((F.col("n_marked") > 0) & first_wide, below).otherwise(0),
        "n_spanned": F.when(anchored, F.greatest(spanned, F.lit(1))).otherwise(0),
    })
    guessed = F.when(F.col("n_spanned") > 0, run(F.col("n_title"), F.col("n_spanned"))).when(some & F.col("header_rows").isNull() & (F.col("rows") > 0), F.array(zero)).otherwise(F.array().cast("array<int>"))
    t = t.withColumns({
        "too_many": given & (F.col("header_rows") > F.col("rows")),
        "ragged": ~given & has_marks & ((F.get("marked", zero) != 0) | (F.col("n_marked") != F.size("marked"))),
        "heads": F.when(given, F.when(F.col("header_rows") > F.col("rows"), F.array().cast("array<int>")).otherwise(run(zero, F.col("header_rows")))).when(has_marks, run(zero, F.col("n_marked") + F.col("n_below"))).otherwise(guessed),
        "titles": F.when(given | has_marks, F.array().cast("array<int>")).otherwise(run(zero, F.col("n_title"))),
    })
    t = t.withColumn("inferred", some & ((~given & ~has_marks & (F.size("heads") > 0)) | F.coalesce(F.col("structure_source") == "markdown_pipe_table", F.lit(False))))
    if n:  # three plans read it
        t = bucketed(t, n, "table_id")
    heads = t.select(*KEY, "rows", "cols", "heads", F.greatest(F.coalesce(F.array_max("heads"), zero), zero).alias("last"))
    tall = c.filter("row_span > 1").join(held(heads, n), KEY).filter(F.expr("array_contains(heads, start_row)") & F.col("start_col").between(0, F.col("cols") - 1)).groupBy(*KEY).agg(F.array_sort(F.collect_set("start_col")).alias("tall"))
    covered = s.join(held(heads, n), KEY).filter("r > last and r < rows and c >= 0 and c < cols").groupBy(*KEY).agg(F.count("*").alias("n_covered"))
    g = near(grid.withColumnRenamed("cell_id", "ref"), n, "table_id").join(c.select(*KEY, F.col("cell_id").alias("ref"), "start_row", "start_col", "row_span", "col_span"), [*KEY, "ref"], "left")
    origin = (F.col("start_row") == F.col("r")) & (F.col("start_col") == F.col("c"))
    inside = F.col("r").between(F.col("start_row"), F.col("start_row") + F.col("row_span") - 1) & F.col("c").between(F.col("start_col"), F.col("start_col") + F.col("col_span") - 1)
    refs = g.groupBy(*KEY).agg(F.count_if(~F.coalesce(F.when(F.col("kind") == "origin", origin).otherwise(inside), F.lit(False))).alias("n_bad_slots"), F.countDistinct("r").alias("grid_rows"), F.count("*").alias("grid_slots"), (F.max("c") + 1).alias("grid_cols"))
    t = t.join(tall, KEY, "left").join(covered, KEY, "left").join(refs, KEY, "left")
    t = t.withColumns({
        "row_heads": F.when(F.size("row_header_columns") > 0, F.col("row_header_columns")).otherwise(F.coalesce("tall", F.array().cast("array<int>"))),
        "n_holes": F.when(F.col("n_cells").isNull(), 0).otherwise(F.greatest(F.col("rows") - 1 - F.greatest(F.coalesce(F.array_max("heads"), zero), zero), zero) * F.col("cols") - F.coalesce("n_covered", zero)),
        "bad_grid_size": F.col("grid_rows").isNotNull() & ((F.col("grid_rows") != F.col("rows")) | (F.col("grid_cols") != F.col("cols")) | (F.col("grid_slots") != F.col("rows") * F.col("cols"))),
    })
    counts = {c: F.coalesce(c, zero).cast("long") for c in ("n_cells", "n_duplicate", "n_negative", "n_overflow", "n_conflict", "n_holes", "n_bad_slots")}
    t = t.withColumns(counts)
    valid = (F.col("n_cells") > 0) & (F.col("n_duplicate") + F.col("n_negative") + F.col("n_overflow") + F.col("n_conflict") + F.col("n_holes") + F.col("n_bad_slots") == 0) & ~F.coalesce("bad_grid_size", F.lit(False)) & ~F.col("too_many") & ~F.coalesce("ragged", F.lit(False))
    return t.withColumn("valid", valid).select(*tables.columns, "rows", "cols", "heads", "titles", "row_heads", "inferred", *counts, F.coalesce("bad_grid_size", F.lit(False)).alias("bad_grid_size"), "too_many", F.coalesce("ragged", F.lit(False)).alias("ragged"), "valid")


def analysis(f: Facts) -> DataFrame:
    """The grid analysis of the facts, made once."""
    if "grid" not in f.cache:
        a = grid_analysis(f.tables, f.cells, f.grid, f.buckets)
        f.cache["grid"] = bucketed(a, f.buckets, "table_id") if f.buckets else materialized(a)
    return f.cache["grid"]


def grid_issues(a: DataFrame) -> DataFrame:
    one = F.array("block_id")
    none = F.array().cast("array<string>")
    t = F.col("table_id")
    kinds = (
        ("n_cells = 0", "QL-TBL-003", "table_grid", F.lit("a table has no cells"), none),
        ("n_duplicate > 0", "QL-TBL-001", "table_structure", text("table ", t, " has duplicate cell ids"), one),
        ("n_negative > 0", "QL-TBL-001", "table_grid", text(F.col("n_negative"), " cells of ", t, " have negative places"), none),
        ("n_overflow > 0", "QL-TBL-001", "table_grid", text(F.col("n_overflow"), " cells of ", t, " leave ", F.col("rows"), " x ", F.col("cols")), none),
        ("n_conflict > 0", "QL-TBL-002", "table_grid", text(F.col("n_conflict"), " slots of ", t, " are taken twice"), none),
        ("bad_grid_size", "QL-TBL-002", "table_structure", text("the grid of ", t, " has another size"), one),
        ("n_bad_slots > 0", "QL-TBL-002", "table_structure", text(F.col("n_bad_slots"), " grid slots of ", t, " point to a wrong cell"), one),
        ("too_many", "QL-TBL-003", "table_header_structure", text("header_rows of ", t, " exceed its rows"), one),
        ("ragged", "QL-TBL-003", "table_header_structure", text("header marks of ", t, " don't run from row 0"), none),
        ("n_cells > 0 and n_holes > 0", "QL-TBL-002", "table_grid", text(F.col("n_holes"), " data slots of ", t, " are empty"), none),
    )
    return union(*[issue(a.filter(c), rule, WARNING, cat, msg, b) for c, rule, cat, msg, b in kinds])


def column_paths(a: DataFrame, cells: DataFrame, n: int | None = None) -> DataFrame:
    """(doc_id, table_id, c, path, cells, certain): header texts over each column, by row; certain unless two cover a row."""
    cells = identified(cells)
    heads = a.select(*KEY, F.explode("heads").alias("start_row"))
    h = cells.join(held(heads, n), [*KEY, "start_row"]).withColumn("c", F.explode(F.sequence(F.greatest("start_col", F.lit(0)), F.col("start_col") + F.col("col_span") - 1)))
    by_row = h.groupBy(*KEY, "c", "start_row").agg(F.count("*").alias("k"), F.min(F.struct(strip(F.col("text")).alias("t"), "cell_id")).alias("x"))
    p = by_row.groupBy(*KEY, "c").agg(F.max("k").alias("k"), F.array_sort(F.collect_list(F.when(F.col("x.t") != "", F.struct("start_row", "x.t", "x.cell_id")))).alias("p"))
    cols = a.filter("cols > 0").select(*KEY, "cols", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    e = F.array().cast("array<string>")
    return cols.join(p, [*KEY, "c"], "left").select(*KEY, "c", F.coalesce("p.t", e).alias("path"), F.coalesce("p.cell_id", e).alias("path_cells"), (F.coalesce("k", F.lit(0)) <= 1).alias("certain"))


def column_path_rule(f: Facts) -> Result:
    a = analysis(f)
    p = column_paths(a.filter("valid and num_cols > 0"), f.cells, f.buckets)
    bad = p.filter(~F.col("certain") | (F.size("path") == 0))
    i = union(grid_issues(a), issue(bad, "QL-TBL-004", WARNING, "table_field_binding", text("column ", F.col("c"), " of ", F.col("table_id"), " has no certain path")))
    b = bad.select(*KEY).distinct().withColumn("uncertain", F.lit(True))
    s = a.join(b, KEY, "left").groupBy("doc_id").agg(F.bool_and(F.col("valid") & F.col("uncertain").isNull()).alias("ok"), F.bool_or("inferred").alias("inferred"), F.array_sort(F.collect_set(text(F.col("table_id"), ".cells"))).alias("refs"))
    return Result(i, observe(s, "table_grid_reliable", F.when(~F.col("ok"), MANUAL).when(F.col("inferred"), INFERRED).otherwise(VERIFIED), F.col("refs")))


def row_keys(a: DataFrame, cells: DataFrame, n: int | None = None) -> DataFrame:
    """(doc_id, table_id, start_row, row_path, row_key, explicit, repeated): keys of data rows.

    Sources are the row's own header cells, then cells that cover a row-header column (so a merged header
    is inherited), each once; without any, the first cell of the row. Rows with a blank key have none.
    """
    cells = identified(cells)
    ok = a.filter("valid").select(*KEY, "rows", "heads", "row_heads", "row_header_columns", F.coalesce(F.array_max("heads"), F.lit(-1)).alias("last"))
    own = cells.join(held(ok, n), KEY).filter("start_row > last and start_row < rows")
    firsts = own.groupBy(*KEY, "start_row").agg(F.min_by(F.struct("cell_id", strip(F.col("text")).alias("t")), F.struct("start_col", "cell_id")).alias("first"))
    marked = own.filter("row_header").select(*KEY, "start_row", F.lit(0).alias("o"), F.col("start_col").alias("k"), "cell_id", strip(F.col("text")).alias("t"), F.lit(True).alias("explicit"))
    # only slots of row-header columns are looked at
    free = slots(cells.join(held(ok.filter("size(row_heads) > 0").select(*KEY, "row_heads"), n), KEY)).filter("array_contains(row_heads, c)")
    free = free.groupBy(*KEY, "r", "c").agg(F.count("*").alias("n"), F.min(F.struct("cell_id", strip(F.col("text")).alias("t"))).alias("x")).filter("n = 1")
    cover = free.join(held(ok.select(*KEY, "last", "rows", "row_header_columns", F.posexplode("row_heads").alias("k", "c")), n), [*KEY, "c"]).filter("r > last and r < rows")
    inherited = cover.select(*KEY, F.col("r").alias("start_row"), F.lit(1).alias("o"), "k", "x.cell_id", "x.t", (F.size("row_header_columns") > 0).alias("explicit"))
    once = F.row_number().over(Window.partitionBy(*KEY, "start_row", "cell_id").orderBy("o", "k"))
    src = near(marked.union(inherited), n, "table_id").withColumn("once", once)
    g = src.groupBy(*KEY, "start_row").agg(F.array_sort(F.collect_list(F.when(F.col("once") == 1, F.struct("o", "k", "t", "cell_id")))).alias("s"), F.bool_or("explicit").alias("explicit"))
    j = firsts.join(g, [*KEY, "start_row"], "left")
    texts = F.when(F.size("s") > 0, F.col("s.t")).otherwise(F.array("first.t"))
    ids = F.when(F.size("s") > 0, F.col("s.cell_id")).otherwise(F.array("first.cell_id"))
    j = j.withColumn("row_path", F.filter(texts, lambda x: x != "")).withColumn("row_cells", ids).withColumn("row_key", F.array_join("row_path", " / ")).filter("row_key <> ''")
    return j.select(*KEY, "start_row", "row_path", "row_cells", "row_key", F.coalesce("explicit", F.lit(False)).alias("explicit"), (F.count("*").over(Window.partitionBy(*KEY, "row_key")) > 1).alias("repeated"))


def external(a: DataFrame) -> Column:
    """Tables whose cells or slots exceed the inline limit are bound by the table index."""
    return F.greatest(F.coalesce("n_cells", F.lit(0)), (F.col("rows") * F.col("cols")).cast("long")) > EXTERNAL_CELLS


def bindings(f: Facts, inline: bool = True) -> DataFrame:
    """(doc_id, table_id, block_id, cell_id, row, col, row_path, column_path, value, state): data cells with their keys."""
    a = analysis(f).filter("valid")
    a = a.filter(~external(a)) if inline else a
    cells = identified(f.cells)
    b = last_blocks(f.blocks, source_block_id="source_block_id")
    n = f.buckets
    t = near(a.select(*KEY, "block_id", "page_number", "inferred", "row_heads", F.col("bbox").alias("table_bbox")).join(b, ["doc_id", "block_id"], "left"), n, "table_id")
    d = cells.filter(~F.coalesce("column_header", F.lit(False)) & ~F.coalesce("row_header", F.lit(False))).join(held(t, n), KEY).filter(~F.array_contains("row_heads", F.col("start_col")))
    paths = column_paths(a, f.cells, n).filter("certain and size(path) > 0").withColumnRenamed("c", "start_col")
    d = d.join(held(row_keys(a, f.cells, n), n), [*KEY, "start_row"]).join(held(paths, n), [*KEY, "start_col"])
    traced = F.coalesce("source_block_id", F.lit("")) != ""
    state = F.when(F.col("repeated") | (~traced if inline else F.lit(False)), MANUAL).when(~F.col("inferred") & F.col("explicit"), VERIFIED).otherwise(INFERRED)
    return d.select(*KEY, "block_id", "cell_id", F.col("start_row").alias("row"), F.col("start_col").alias("col"), "row_path", "row_key", F.col("path").alias("column_path"), "row_cells", "path_cells", strip(F.col("text")).alias("value"), state.alias("state"), "page_number", F.when(F.col("bbox").isNotNull(), "cell").when(F.col("table_bbox").isNotNull(), "table").alias("bbox_granularity"))


def binding_rule(f: Facts) -> Result:
    a = analysis(f)
    d = row_keys(a.filter(~external(a)), f.cells, f.buckets).filter("repeated").groupBy(*KEY).agg(F.array_sort(F.collect_set("row_key")).alias("keys")).join(f.tables.select(*KEY, "block_id"), KEY)
    i = union(grid_issues(a.filter("not valid")), issue(d, "QL-TBL-005", WARNING, "table_field_binding", text("row keys repeat: ", F.array_join("keys", ", ")), F.array("block_id"), MANUAL))
    b = materialized(bindings(f))
    s = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == VERIFIED).alias("v"), F.bool_or(F.col("state") == MANUAL).alias("m"))
    refs = a.groupBy("doc_id").agg(F.array_sort(F.collect_set(text(F.col("table_id"), ".cells"))).alias("refs"))
    o = observe(s.join(refs, "doc_id"), "table_field_binding_reliable", F.when(F.col("m"), MANUAL).when(F.col("v") == F.col("n"), VERIFIED).otherwise(INFERRED), F.col("refs"))
    x = a.filter(F.col("valid") & external(a)).groupBy("doc_id").agg(F.array_sort(F.collect_set(text(F.col("table_id"), ".external_table_index"))).alias("refs"))
    return Result(i, union(o, observe(x, "table_field_binding_reliable", F.lit(INFERRED), F.col("refs"))), None, b)


def empty_tables(f: Facts) -> Result:
    filled = f.cells.filter(~blank(F.col("text"))).select(*KEY).distinct()
    return Result(issue(f.tables.join(filled, KEY, "left_anti"), "QL-TBL-003", "critical", "table_structure", text("table ", F.col("table_id"), " holds no text"), F.array("block_id")))


def evidence_integrity(f: Facts) -> Result:
    t, cells = f.tables, identified(f.cells)
    nested = cells.filter("(row_span > 1 or col_span > 1) and (instr(text, '\t') > 0 or length(text) - length(replace(text, '\n', '')) >= 2)").join(t.select(*KEY, "block_id"), KEY)
    emitted, source, hidden = F.col("emitted_row_count"), F.col("source_row_count"), F.col("hidden_row_count")
    view = F.col("source_row_count").isNotNull()
    scope = F.when(view & (F.coalesce("view_scope", F.lit("unknown")) == "unknown"), "unknown").when(view & (F.col("view_scope") == "all_rows") & (emitted != source), "all_rows").when(view & (F.col("view_scope") == "visible_rows") & (emitted + hidden != source), "visible_rows")
    p = t.select("doc_id", F.col("table_id").alias("parent_table_id"), F.col("nesting_depth").alias("parent_depth"))
    pc = cells.select("doc_id", F.col("table_id").alias("parent_table_id"), F.col("cell_id").alias("parent_cell_id"), F.lit(True).alias("has_cell")).distinct()
    kids = t.filter("parent_table_id is not null").join(p, ["doc_id", "parent_table_id"], "left").join(pc, ["doc_id", "parent_table_id", "parent_cell_id"], "left")
    orphan = kids.filter(F.col("parent_depth").isNull() | F.col("has_cell").isNull() | (F.coalesce("nesting_depth", F.lit(0)) != F.col("parent_depth") + 1))
    one, name = F.array("block_id"), F.col("table_id")
    bad_rows, bad_hidden = t.filter(emitted != F.col("num_rows")), t.filter(hidden > source)
    views = t.withColumn("scope", scope).filter("scope is not null")
    i = union(
        issue(nested, "QL-TBL-010", WARNING, "table_pseudo_nested", text("cell ", F.col("cell_id"), " looks like a table of its own"), one, MANUAL),
        issue(bad_rows, "QL-TBL-010", WARNING, "table_structure", text("table ", name, " emits another number of rows"), one, MANUAL),
        issue(bad_hidden, "QL-TBL-010", WARNING, "table_view", text("table ", name, " hides more rows than it has"), one, MANUAL),
        issue(views, "QL-TBL-010", WARNING, "table_view", text("table ", name, " can't be reconciled as ", F.col("scope")), one, MANUAL),
        issue(orphan, "QL-TBL-010", WARNING, "table_structure", text("table ", name, " has a wrong parent"), one, MANUAL),
    )
    broken = union(*[x.select("doc_id") for x in (bad_rows, bad_hidden, orphan)]).distinct().withColumn("broken", F.lit(True))
    s = t.groupBy("doc_id").agg(F.array_sort(F.collect_set(text(name, ".cells"))).alias("refs")).join(broken, "doc_id", "left")
    v = t.filter(view).groupBy("doc_id").agg(F.bool_or(scope.isNotNull()).alias("bad"), F.array_sort(F.collect_set(text(name, ".view_scope"))).alias("refs"))
    return Result(i, union(observe(s, "table_structure_reliable", F.when(F.col("broken"), MANUAL).otherwise(VERIFIED), F.col("refs")), observe(v, "table_view_scope_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED), F.col("refs"))))


def anchor_copy(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, rendered): pipe Markdown in which covered slots repeat their origin's text."""
    x = grid.join(identified(cells).select(*KEY, "cell_id", "text"), [*KEY, "cell_id"], "left")
    rows = x.groupBy(*KEY, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", escape_cell(F.col("text")).alias("t")))), lambda s: s["t"]).alias("v"))
    width = Window.partitionBy(*KEY)
    rows = rows.withColumn("w", F.max(F.size("v")).over(width)).withColumn("v", F.concat("v", F.array_repeat(F.lit(""), F.col("w") - F.size("v"))))
    line = F.concat(F.lit("| "), F.array_join("v", " | "), F.lit(" |"), F.when(F.col("r") == 0, F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))).otherwise(""))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda s: s["l"]), "\n").alias("rendered"))


def representation(f: Facts) -> Result:
    b = last_blocks(f.blocks, kind="kind", block_md="markdown")
    t = f.tables.join(b, ["doc_id", "block_id"], "left").join(f.documents.select("doc_id", F.col("markdown").alias("doc_md")), "doc_id", "left")
    html, md = F.coalesce("html", F.lit("")), F.coalesce("markdown", F.lit(""))
    still = ((html != "") & (blank(md) | F.lower(md).contains("<table"))) | ((html != "") & F.coalesce(F.col("doc_md").contains(F.col("html")), F.lit(False)))
    alone = ~still & (F.col("kind").isNull() | (F.col("kind") != "table"))
    rest = ~still & ~alone
    bm = strip(F.coalesce("block_md", F.lit("")))
    kinds = ((still, "is still HTML or empty", "open"), (alone, "has no table block", MANUAL), (rest & (strip(md) != bm), "differs from its block", MANUAL), (rest & (bm != "") & ~F.coalesce(F.col("doc_md").contains(bm), F.lit(False)), "isn't in the document", MANUAL))
    nl = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))
    raw = f.cells.filter(nl(F.col("raw_value")).contains("\n") & (nl(F.col("raw_value")) != nl(F.col("text")))).groupBy(*KEY).agg(F.count("*").alias("n"))
    i = union(*[issue(t.filter(c), "QL-TBL-009", WARNING, "table_representation", text("table ", F.col("table_id"), " ", F.lit(m)), F.array("block_id"), st) for c, m, st in kinds], issue(t.filter(rest).join(raw, KEY), "QL-TBL-009", WARNING, "table_representation", text(F.col("n"), " cells of ", F.col("table_id"), " lost line ends"), F.array("block_id"), MANUAL))
    bad = i.select("doc_id").distinct().withColumn("bad", F.lit(True))
    s = t.groupBy("doc_id").agg(F.array_sort(F.collect_set(text(F.col("table_id"), ".markdown"))).alias("refs")).join(bad, "doc_id", "left")
    return Result(i, observe(s, "table_representation_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED), F.col("refs")))


def adjacent_pairs(f: Facts) -> DataFrame:
    """Tables next to each other in reading order on consecutive pages: columns a and b (structs), headers, hint, drift."""
    a = analysis(f)
    n = f.buckets
    heads = column_paths(a.filter("valid"), f.cells, n).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.array_join(F.transform("path", lambda p: F.regexp_replace(p, r"(?U)\s+", "")), "/").alias("h")))), lambda x: x["h"]).alias("headers"))
    # only tables with such a word anywhere need the order of their cells
    some = f.cells.filter(F.col("text").rlike(CONTINUATION)).select(*KEY).distinct()
    words = identified(f.cells).join(held(some, n), KEY, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("start_row", "start_col", "cell_id"))).filter("n <= 60").groupBy(*KEY).agg(F.bool_or(F.col("text").rlike(CONTINUATION)).alias("cell_hint"))
    width = F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))
    geo = identified(f.cells).filter("column_header and bbox is not null").join(a.filter(F.col("valid") & (width > 0)).select(*KEY, "cols", F.get("bbox", F.lit(0)).alias("left"), width.alias("width")), KEY).withColumn("c", F.explode(F.sequence("start_col", F.col("start_col") + F.col("col_span") - 1)))
    geo = geo.groupBy(*KEY, "cols", "c").agg(F.max_by(F.struct((((F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2 - F.col("left")) / F.col("width")).alias("m"), ((F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) / F.col("width")).alias("w")), F.struct("start_row", "start_col")).alias("g"))
    geo = geo.groupBy(*KEY, "cols").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "g"))), lambda x: x["g"]).alias("geometry"), F.count("*").alias("k")).filter("k = cols").select(*KEY, "geometry")
    b = last_blocks(f.blocks, order_index="order_index", source_block_id="source_block_id", block_hint=F.concat_ws(" ", "text", "markdown").rlike(CONTINUATION))
    t = near(a.join(b, ["doc_id", "block_id"], "left"), n, "table_id").join(heads, KEY, "left").join(words, KEY, "left").join(geo, KEY, "left")
    hint = F.coalesce(F.col("caption").rlike(CONTINUATION), F.lit(False)) | F.coalesce("block_hint", F.lit(False)) | F.coalesce("cell_hint", F.lit(False))
    t = t.select("doc_id", F.struct("table_id", "block_id", "page_number", F.col("order_index").alias("ord"), "source_block_id", "num_cols", F.when(F.col("valid"), F.col("headers")).alias("headers"), (F.col("bbox").isNotNull()).alias("boxed"), "geometry", hint.alias("hint")).alias("a"))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce(F.col("a.ord").cast("long"), F.lit(10**12)), "a.block_id", "a.table_id")
    t = t.withColumn("b", F.lead("a").over(w)).filter("b.page_number = a.page_number + 1 and b.ord > a.ord and size(a.headers) > 0 and size(b.headers) > 0")
    ga, gb = F.col("a.geometry"), F.col("b.geometry")
    drift = F.when(F.size(ga) == F.size(gb), F.exists(F.zip_with(ga, gb, lambda x, y: (F.abs(x["m"] - y["m"]) > DRIFT) | (F.abs(x["w"] - y["w"]) > DRIFT)), lambda x: x))
    cols = lambda s: F.when(F.coalesce(F.col(f"{s}.num_cols"), F.lit(0)) > 0, F.col(f"{s}.num_cols")).otherwise(F.size(f"{s}.headers"))
    t = t.withColumns({"hint": F.col("a.hint") | F.col("b.hint"), "exact": F.col("a.headers") == F.col("b.headers"), "drift": drift, "same_cols": cols("a") == cols("b")})
    return t.filter(F.col("hint") | F.col("exact") | (F.size(F.array_intersect("a.headers", "b.headers")) >= 2))


def pairs(f: Facts) -> DataFrame:
    """The adjacent pairs of the facts, made once."""
    if "pairs" not in f.cache:
        f.cache["pairs"] = materialized(adjacent_pairs(f))
    return f.cache["pairs"]


def continuation(f: Facts) -> Result:
    p = pairs(f).filter("same_cols").join(order_conflicts(f.blocks).withColumn("conflict", F.lit(True)), "doc_id", "left")
    sourced = (F.coalesce("a.source_block_id", F.lit("")) != "") & (F.coalesce("b.source_block_id", F.lit("")) != "")
    sure = F.col("exact") & (F.col("hint") | (F.col("a.boxed") & F.col("b.boxed"))) & ~F.coalesce("drift", F.lit(False)) & F.col("conflict").isNull() & sourced
    p = p.withColumn("state", F.when(sure, VERIFIED).otherwise(MANUAL))
    i = issue(p.filter(~sure), "QL-TBL-007", WARNING, "cross_page_table", text("weak continuation ", F.col("a.table_id"), " to ", F.col("b.table_id")), F.array("a.block_id", "b.block_id"))
    r = p.select("doc_id", F.lit("table_continuation").alias("relation_type"), F.col("a.block_id").alias("from_id"), F.col("b.block_id").alias("to_id"), "state", text(F.col("a.table_id"), "->", F.col("b.table_id")).alias("marker_key"))
    s = r.groupBy("doc_id").agg(F.bool_and(F.col("state") == VERIFIED).alias("ok"))
    return Result(i, observe(s, "cross_page_continuation", F.when(F.col("ok"), VERIFIED).otherwise(MANUAL)), r)


def column_drift(f: Facts) -> Result:
    p = pairs(f)
    why = F.array_compact(F.array(F.when(~F.col("same_cols"), "column_count").when(~F.col("exact"), "column_order_or_header"), F.when(F.col("drift"), "column_bbox")))
    p = p.withColumn("why", why)
    i = issue(p.filter(F.size("why") > 0), "QL-TBL-008", WARNING, "column_drift", text("columns drift from ", F.col("a.table_id"), " to ", F.col("b.table_id"), ": ", F.array_join("why", ", ")), F.array("a.block_id", "b.block_id"))
    s = p.groupBy("doc_id").agg(F.bool_or(F.size("why") > 0).alias("bad"))
    return Result(i, observe(s, "table_column_drift_reliable", F.when(F.col("bad"), MANUAL).otherwise(VERIFIED)))
