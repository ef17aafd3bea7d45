"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger is a table in a shared folder with a row for each
(blob, rule version) pair that was scanned, and its spans. Only pairs that the ledger lacks are scanned, each once
however many paths carry the blob, and appended; the ledger's spans are then joined back to all paths. Texts are
scanned where they lie: of equal texts the one of the smallest id, the other rows are left out by their ids and
addresses. A ledger that stays (`path`, or the session's setting LEDGER) makes the next run incremental; a write that
was broken off leaves no rows, and rows written twice count once. Spans are code points, end exclusive. A pattern's matches and the gaps between
them have their lengths summed up to positions, so all spans of a text cost one pass for each rule.

Base kinds: assign, access, hex; more kinds add spans. Null texts count as empty: no spans. Equal texts
get equal spans; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.llm.common import cut, ensure_checkpoint_dir, few

RULE_VERSION = "1"
LEDGER = "spark.lithoframe.secrets.ledger"
SPANS = "array<struct<start:int,rule:int,kind:string,end:int>>"
ROWS = f"blob string, rule_version string, spans {SPANS}"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ("assign", "access", "hex")
#: (kind, pattern, least characters, group that is measured, text that must occur)
RULES = (
    ("assign", ASSIGN, 12, 2, None),
    ("access", r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 16, 0, None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0, "xox"),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0, "eyJ"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, 0, "PRIVATE KEY"),
)
PLACEHOLDER = "[SECRET]"


def matches(text: Column, order: int, kind: str, pattern: str, least: int, group: int, must: str | None) -> Column:
    """array<struct<rule, kind, i, gap, n, ok>>: a pattern's matches, each with the length of the gap before it."""
    seen = text.rlike(pattern) if must is None else text.contains(must) & text.rlike(pattern)

    def one(gap: Column, x: Column) -> Column:
        measured = x if group == 0 else F.regexp_extract(x, pattern, group)
        return F.struct(F.lit(order).alias("rule"), F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(x).alias("n"), (F.length(measured) >= least).alias("ok"))

    # one gap more than matches: the last pair has no match
    return F.when(seen, F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)).otherwise(F.array().cast("array<struct<rule:int,kind:string,gap:int,n:int,ok:boolean>>"))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, spans array<struct<start, rule, kind, end>>) of (blob, text), a row for each blob."""
    found = F.concat(*[matches(F.col("text"), i, *r) for i, r in enumerate(RULES)])
    rows = blobs.select("blob", F.posexplode_outer(found).alias("i", "m")).select("blob", "i", "m.*")
    # equal rows may bring a blob twice; one exchange serves this step, the window and the aggregation
    rows = rows.repartition("blob").dropDuplicates(["blob", "rule", "i"])
    w = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(w)
    spans = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("n"))
    good = F.when(F.col("ok"), F.struct("start", "rule", "kind", "end"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(good)).alias("spans")).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")


def addressed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with __text (null: empty) and its address __blob."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"__text": text, "__blob": F.sha2(text, 256)})


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows of the current rules, one for each blob."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.range(0).select(F.lit("").alias("blob"), F.lit(RULE_VERSION).alias("rule_version"), F.array().cast(SPANS).alias("spans"))
    rows = spark.read.schema(ROWS).parquet(path).filter(F.col("rule_version") == RULE_VERSION)
    return rows.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def unseen(df: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, text) of the blobs of df that the ledger lacks; one row for each, unless equal rows have the same id."""
    own = addressed(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t").select("__id", F.col("__blob").alias("blob"), F.col("__text").alias("text"))
    paths = cut(own.select("__id", "blob"))
    reps = paths.groupBy("blob").agg(F.min("__id").alias("rep"), F.count("*").alias("n"))
    known = reps.join(ledger.select("blob"), "blob", "left_semi").select("blob", "rep")
    # rows that needn't be scanned: copies other than the representative, and what the ledger has
    copies = paths.join(reps.filter("n > 1").select("blob", "rep"), "blob").filter(~F.col("__id").eqNullSafe(F.col("rep")))
    left_out = copies.select("__id", "blob").union(known.select("rep", "blob")).select(F.col("__id").alias("i"), F.col("blob").alias("b")).distinct()
    return own.join(few(left_out), F.col("__id").eqNullSafe(F.col("i")) & (F.col("blob") == F.col("b")), "left_anti").select("blob", "text")


def update_ledger(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks of df's blobs, append it and return the ledger's rows of the current rules."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or spark.conf.get(LEDGER, None) or f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    fresh = scan_blobs(unseen(df, read_ledger(spark, path), id_col, text_col))
    fresh.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array) of every path (row), by way of the ledger."""
    known = update_ledger(df, path, id_col, text_col).filter(F.size("spans") > 0).select("blob", "spans")
    paths = addressed(df, text_col).select(id_col, "__blob")
    return paths.join(known, F.col("__blob") == F.col("blob"), "left").select(id_col, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of the base kinds, the base spans' digest and all spans of every document."""
    s = F.col("spans")

    def of(*kinds: str) -> Column:
        return F.filter(s, lambda x: x["kind"].isin(*kinds))

    count = {f"n_{k}": F.size(of(k)).cast("long") for k in BASE}
    base = joined(of(*BASE))
    return find_secrets(df, path).select("doc_id", *[v.alias(k) for k, v in count.items()], F.sha2(base, 256).alias("base_sha256"), joined(s).alias("spans"))


def redact(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every found span replaced by a placeholder; rows and columns stay."""
    known = update_ledger(df, path, id_col, text_col).filter(F.size("spans") > 0).select(F.col("blob").alias("__found"), F.col("spans").alias("__spans"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, F.when(s["end"] > acc["at"], F.lit(PLACEHOLDER)).otherwise("")).alias("out"))

    clean = F.aggregate(F.col("__spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    j = addressed(df, text_col).join(known, F.col("__blob") == F.col("__found"), "left")
    return j.withColumn(text_col, F.when(F.col("__spans").isNotNull(), clean).otherwise(text)).select(*df.columns)


def _oracle() -> str:
    parts = []
    for i, (kind, pattern, least, group, _) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rule, '{kind}' AS kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS x, unnest(gs[1:len(ms)]) AS g, "
            f"unnest(list_transform(ms, lambda x: length(regexp_extract(x, '{p}', {group})) >= {least})) AS ok "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d)"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    zero = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, (sum(length(g) + length(x)) OVER (PARTITION BY doc_id, rule ORDER BY i))::BIGINT AS stop FROM m),
s AS (SELECT doc_id, rule, kind, stop - length(x) AS start, kind || ':' || (stop - length(x)) || ':' || stop AS span FROM p WHERE ok),
a AS (SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (kind IN ({base})), '') AS b, string_agg(span, ',' ORDER BY start, rule) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLE_SQL = _oracle()
