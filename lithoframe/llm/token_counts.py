"""Exact histogram of encoded lengths; suffix sums answer every context limit.

`histogram` counts documents by encoded length (the encoding runs where the text is; only lengths are
shuffled, summed map-side). `suffix_sums` turns a histogram into one row per length L that occurs:
documents and tokens at that length, documents and tokens of at least L, the total when every document
is truncated to L, what truncation drops, and the share of documents of at most L.

Prefix sums go in two levels (blocks of lengths, then within a block), so no task holds the histogram.
Null texts have length 0 and are counted. An empty table gives no row.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.llm.bpe import read_ranks
from lithoframe.llm.common import cut


@lru_cache(4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def lengths(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row (n_tokens) for each document."""

    def run(batches):
        encode = encoding(ranks_path, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return df.select(text_col).mapInArrow(run, "n_tokens long")


def histogram(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Histograms of parts add up."""
    return lengths(df, ranks_path, pattern, text_col).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = 4096) -> DataFrame:
    """One row per length: see the module's text."""
    h = hist.withColumn("blk", F.expr(f"n_tokens div {block}"))
    blocks = h.groupBy("blk").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    after = Window.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    # a row per block of lengths: a few thousand even where the longest document has millions of tokens
    blocks = blocks.select("blk", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t_after"), F.sum("bd").over(Window.partitionBy()).alias("all_docs"), F.sum("bt").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("blk").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    j = h.join(blocks, "blk").withColumns({"docs_ge": F.col("d_after") + F.sum("n_docs").over(own), "tokens_ge": F.col("t_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(own)})
    truncated = F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return j.select("n_tokens", "n_docs", (F.col("n_docs") * F.col("n_tokens")).alias("tokens"), "docs_ge", "tokens_ge", "all_docs", "all_tokens", truncated.alias("truncated_total"), (F.col("all_tokens") - truncated).alias("dropped_total"), (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over) for any limits, whether or not a document has that length.

    Limits are parameters, so the table that is summed grows with their number and not with the corpus.
    """
    reach = sums.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))])))
    over = F.col("n_tokens") > F.col("context_limit")
    total = F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit"))
    return reach.groupBy("context_limit").agg(total.alias("truncated_total"), F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"))


def quantile(sums: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(n_tokens): the smallest length that at least numerator/denominator of the documents don't exceed."""
    return sums.filter(F.col("docs_le") * denominator >= F.col("all_docs") * numerator).agg(F.min("n_tokens").alias("n_tokens"))


def count_table(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Histogram (cut from its lineage, as both levels read it) and its suffix sums."""
    return suffix_sums(cut(histogram(df, ranks_path, pattern, text_col)))
