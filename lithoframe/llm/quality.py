"""Quality rules with thresholds that follow each language and source.

Measures of each document (integers) are gathered in mergeable quantile sketches: counts per rounded
value, kept exact below 64 and to six leading bits above, so a sketch of parts is the sum of their
sketches, in any order. From the sketch of its language and source (of its language, then of all, where
fewer than `least` documents were seen) each document gets the limits

    upper quartile + spread * max(upper quartile - median, step)     for the upper limits
    lower quartile - spread * max(median - lower quartile, step)     for the lower one

and documents beyond a limit, or that fail the base rule, are rejected. Every document is counted. No limit is
fixed: `step` is what one occurrence counts in the shortest text that the base rule lets pass (SHORTEST words), so
that where most of a group have none of something, a handful of it in a short text is no outlier. Quartiles bear up to a
quarter of a group being junk. No step is smaller than the sketch's bins at the median.

Null texts have no words and fail the base rule; null languages and sources form groups of their own;
an empty table gives no row; clashing extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.llm.common import cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

SHORTEST = 50
#: measure -> (numerator, denominator, scale, lower side too)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, False),
    "dup_lines": ("n_dup_lines", "n_words", 1000, False),
    "repeats": ("n_repeat_words", "n_words", 1000, False),
    "upper": ("n_upper", "word_chars", 1000, False),
    "bangs": ("n_bang", "n_words", 1000, False),
    "word_length": ("word_chars", "n_words", 100, True),
}
#: letters in a word, for `event` of the measures that count by letters
LETTERS = 5
BROADCAST_GROUPS = 20_000


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n + 2)
    k = len(ids)
    pair = a[:-1] * k + a[1:]
    if k >= 1 << 20:  # keep the product of three within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    win = pair[:-1] * k + a[2:]
    _, inverse, counts = np.unique(win, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n + 2, bool)
    for d in range(3):
        covered[at + d] = True
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = sum(map(len, words)) - (len(raw) - len(text or ""))
    return len(words), chars, sum([raw.count(s) for s in SYMBOLS]), len(lines) - len(set(lines)), repeat_words(words), len(lines), len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!")


def measure(text_col: str = "text") -> Column:
    """The struct of a text's counts."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [measure_text(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # as if it weren't deterministic: else the optimiser copies it into the filter, and every text is measured twice
    return F.arrow_udf(run, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">").asNondeterministic()(F.col(text_col))


def value(m: str, counts: Column) -> Column:
    num, den, scale, _ = MEASURES[m]
    return F.floor(counts[num] * scale / F.greatest(counts[den], F.lit(1))).cast("long")


def event(m: str) -> int:
    """One occurrence in a text of SHORTEST words, in the measure's units."""
    _, den, scale, _ = MEASURES[m]
    return scale // (SHORTEST if den == "n_words" else SHORTEST * LETTERS)


def rounded(v: Column) -> Column:
    """A sketch's bin, named by its largest value: exact below 64, else six leading bits."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, e) + 1, e) - 1


def sketch(df: DataFrame, counts: Column, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, bin, n): mergeable by summing n. Partial sums leave each task, hot sources included."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), rounded(value(m, counts)).alias("bin")) for m in MEASURES])
    return df.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p")).groupBy("lang", "source", "p.measure", "p.bin").agg(F.count("*").alias("n"))


def thresholds(sk: DataFrame, spread: int, least: int) -> DataFrame:
    """(lang, source, limits map<measure, struct<hi, lo>>) for every language and source of a sketch."""

    def limits(s: DataFrame, keys: list[str]) -> DataFrame:
        own = Window.partitionBy(*keys, "measure")
        c = s.withColumns({"cum": F.sum("n").over(own.orderBy("bin")), "total": F.sum("n").over(own)})

        def q(quarters: int) -> Column:
            return F.min(F.when(F.col("cum") * 4 >= F.col("total") * quarters, F.col("bin")))

        return c.groupBy(*keys, "measure").agg(q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3"), F.max("total").alias("total"))

    def event_of() -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for m in MEASURES for x in (m, event(m))]), F.col("measure")).cast("long")

    def two_sided() -> Column:
        return F.col("measure").isin([m for m in MEASURES if MEASURES[m][3]])

    by_lang = sk.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    a, b = limits(sk, ["lang", "source"]).alias("a"), limits(by_lang, ["lang"]).alias("b")
    c = limits(by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n")), []).alias("c")
    j = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(F.broadcast(c), F.col("a.measure") == F.col("c.measure"))  # c: a row per measure
    pick = {q: F.when(F.col("a.total") >= least, F.col(f"a.{q}")).when(F.col("b.total") >= least, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}")) for q in ("q1", "q2", "q3")}
    r = j.select("a.lang", "a.source", "a.measure", *[v.alias(k) for k, v in pick.items()])
    least_step = F.greatest(event_of(), F.floor(F.col("q2") / 32))  # a sketch tells no finer steps apart
    hi = F.col("q3") + spread * F.greatest(least_step, F.col("q3") - F.col("q2"))
    lo = F.when(two_sided(), F.col("q1") - spread * F.greatest(least_step, F.col("q2") - F.col("q1"))).otherwise(F.lit(-1).cast("long"))
    return r.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct(hi.alias("hi"), lo.alias("lo"))))).alias("limits"))


def within(counts: Column, limits: Column) -> Column:
    ok = F.lit(True)
    for m in MEASURES:
        v, lim = value(m, counts), F.element_at(limits, F.lit(m))
        ok = ok & (v <= lim["hi"]) & (v >= lim["lo"])
    return ok


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < SHORTEST) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def judged(df: DataFrame, counts: Column, th: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """df joined with its thresholds; adds __base_failed and __kept."""
    th = cut(th.withColumnsRenamed({"lang": "__lang", "source": "__source", "limits": "__limits"}))
    if th.count() <= BROADCAST_GROUPS:  # else Spark joins by shuffle and splits hot groups
        th = F.broadcast(th)
    j = df.join(th, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    bad = base_failed(counts)
    return j.withColumns({"__base_failed": bad, "__kept": ~bad & F.coalesce(within(counts, F.col("__limits")), F.lit(False))}).drop("__lang", "__source", "__limits")


def quality_table(df: DataFrame, spread: int = 15, least: int = 100, id_col: str = "doc_id") -> DataFrame:
    """The measures and the verdict on every document; texts are read once and never shuffled."""
    m = cut(df.select(F.col(id_col), "lang", "source", measure("text").alias("__m")))
    counts = F.col("__m")
    j = judged(m, counts, thresholds(cut(sketch(m, counts)), spread, least))
    return j.select(id_col, *[F.col("__m")[c].alias(c) for c in COUNTS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(df: DataFrame, spread: int = 15, least: int = 100) -> DataFrame:
    """The documents that pass, with all their columns. The texts are measured twice and never shuffled."""
    counts = F.col("__m")
    sk = cut(sketch(df.select("lang", "source", measure("text").alias("__m")), counts))
    j = judged(df.withColumn("__m", measure("text")), counts, thresholds(sk, spread, least))
    return j.filter("__kept").select(*df.columns)
