"""Sharding by sampled splitters: near-equal bytes in every shard.

A record's key is (hash of the text, hash of the id), so equal texts lie next to each other.

1. A size-weighted sample of keys (a hash of the key decides, so a retry draws the same sample; its size is a
   parameter, not a share of the corpus) gives quantile boundaries of many fine ranges. They fall between
   different texts, so that equal texts share a range.
2. Exact bytes and rows of each range are summed. Ranges over twice the mean are sampled again and subdivided, up
   to `rounds` times: between different texts where there are any, else between the ids of one very frequent text.
3. Whole ranges are laid out in order over the shards: a range goes where its middle falls among the bytes. So
   shards differ by about a range, and equal texts are in one shard unless they alone are an overfull range.
4. A record's slot is its rank in its range plus the rows of the shard's earlier ranges.

Identical records (repeated rows) are counted first and travel as one row; an overfull range of one such record is cut
between its copies. Null texts have size 1 (no bytes, plus 1); null ids and ids of any type are allowed; an empty table gives no row. Only ids,
hashes and sizes are shuffled; texts never move.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.llm.common import cut


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, ih, size, text_crc32, n): one row for each different record."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.xxhash64(F.lit(7), F.col(id_col)).alias("ih"), (F.length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.groupBy(id_col, "h", "ih", "size", "text_crc32").agg(F.count("*").alias("n"))


def uniform(*of) -> Column:
    """A number from 0 to 1 in steps of 2 to the power -53, from a hash."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*of), F.lit(11)) / F.lit(float(1 << 53))


def draw(keys: DataFrame, total: int, wanted: int, salt: int) -> list[tuple[int, int]]:
    """About `wanted` keys, each with a chance in proportion to its bytes; sorted. As many at any total."""
    chance = F.col("size") * F.col("n") * F.lit(wanted / max(total, 1))
    return sorted((r[0], r[1]) for r in keys.filter(uniform("h", "ih", F.lit(salt)) < chance).select("h", "ih").collect())


LEAST = -(1 << 63)


def quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Boundaries before whole texts; within a text where the sample has no other."""
    chosen = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    if sample and sample[0][0] == sample[-1][0]:
        return chosen
    return sorted({(h, LEAST) for h, _ in chosen} - {(sample[0][0], LEAST)} if sample else [])


def place(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Add rng: how many splitters are at or below the key."""

    @F.arrow_udf("int")
    def rng(h: pa.Array, i: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(splitters, x) for x in zip(h.to_pylist(), i.to_pylist(), strict=True)], pa.int32())

    return keys.withColumn("rng", rng("h", "ih"))


def totals(placed: DataFrame) -> list:
    """(rng, bytes, rows, size) of each range: as many rows as ranges, a parameter. size: of one record repeated, else null."""
    one = (F.min("h") == F.max("h")) & (F.min("ih") == F.max("ih")) & (F.min("size") == F.max("size"))
    return sorted(placed.groupBy("rng").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r"), F.when(one, F.min("size")).alias("size")).collect(), key=lambda x: x[0])


def subdivided(splitters: list[tuple[int, int]], over: dict[int, int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """More splitters: the k-th range in `over` gets over[k] parts, by the sampled keys that lie in it."""
    inside: dict[int, list] = {}
    for key in found:
        if (r := bisect.bisect_right(splitters, key)) in over:
            inside.setdefault(r, []).append(key)
    more = set(splitters)
    for r, keys in inside.items():
        more |= set(quantiles(keys, over[r]))
        low = splitters[r - 1] if r else None
        if keys[0][0] != keys[-1][0]:  # a text that fills a part of its own begins and ends at a boundary
            each = Counter(h for h, _ in keys)
            for h, n in each.items():
                if n * over[r] > len(keys):
                    more |= {(h, LEAST), (h + 1, LEAST)} - {low}
    return sorted(more)


def layout(known: list, shards: int, full: float) -> list[tuple[int, int, int, int, int]]:
    """(rng, shard, rows of the shard before, first row, last row): each range goes where its middle falls.

    One record that is repeated for more than `full` bytes is cut between its copies.
    """
    total, b, before, out = sum(x["b"] for x in known), 0, Counter(), []

    def shard(middle2: int) -> int:
        return min(shards - 1, middle2 * shards // (2 * total))

    for x in known:
        cuts, n, size = [0], x["r"], x["size"]
        if size and n > 1 and x["b"] > full:
            for s in range(shard(2 * b + size) + 1, shard(2 * (b + (n - 1) * size) + size) + 1):
                # the first copy whose middle reaches shard s
                cuts.append(-(-(2 * total * s - shards * (2 * b + size)) // (2 * size * shards)))
        for lo, hi in zip(cuts, [*cuts[1:], n], strict=True):
            if lo < hi:
                s = shard(2 * b + x["b"]) if len(cuts) == 1 else shard(2 * (b + lo * size) + size)
                out.append((x["rng"], s, before[s], lo, hi - 1))
                before[s] += hi - lo
        b += x["b"]
    return out


def shard_by_bytes(df: DataFrame, shards: int = 16, ranges: int = 4096, oversample: int = 16, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every record."""
    keys = cut(keyed(df, id_col, text_col))
    all_bytes = keys.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    splitters = quantiles(draw(keys, all_bytes, ranges * oversample, 0), ranges)
    placed = place(keys, splitters)
    known = totals(placed)
    for again in range(1, rounds + 1):
        over = [x for x in known if x["b"] > 2 * all_bytes / ranges]
        if not over:
            break
        inside = placed.filter(F.col("rng").isin([x["rng"] for x in over]))
        found = draw(inside, sum(x["b"] for x in over), ranges * oversample, again)
        more = subdivided(splitters, {x["rng"]: min(ranges, -(-x["b"] * ranges // all_bytes)) for x in over}, found)
        if more == splitters:
            break  # nothing left to subdivide: single records larger than a range
        splitters = more
        placed = place(keys, splitters)
        known = totals(placed)
    # a row for each range, and for each shard that one repeated record reaches
    where = df.sparkSession.createDataFrame(layout(known, shards, 2 * all_bytes / ranges), "rng int, shard int, base long, lo long, hi long")
    before = Window.partitionBy("rng").orderBy("h", "ih", F.col(id_col).asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    at = placed.withColumn("r0", F.coalesce(F.sum("n").over(before), zero))
    each = at.withColumn("i", F.explode(F.sequence(F.col("r0"), F.col("r0") + F.col("n") - 1))).join(F.broadcast(where), "rng").filter("i between lo and hi")
    return each.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("i") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
