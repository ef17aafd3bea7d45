"""Removal of long repeats over the whole corpus by external induced suffix sorting.

A byte goes if it lies in a `length`-byte string that also starts anywhere else. Sorting every suffix of
the corpus is neither possible on one machine nor needed:

1. Reduction. Each window of `length` bytes names one of its `gram`-byte strings, the one of least hash
   (leftmost among equals); equal windows name equal strings at equal places. The named places, one in
   about (length - gram) / 2 bytes, are the sample of suffixes that is sorted; each stands for the run of
   windows that named it. Samples whose string occurs once in the corpus can't be in a repeat and go.
2. Sorted base. The sampled suffixes that are left (with the bytes to the left that their windows need)
   are dealt out by their string and sorted by Spark's external sorter: runs spill to disk and meet in
   a priority queue, so a shard may be far larger than memory. Equal contexts travel as one tuple with
   their number. Neighbours' common-prefix values come from one pass over the sorted tuples.
3. Induction. From the order of the suffixes at a sample the order one byte further left is induced by a
   stable distribution on the preceding byte; the common prefix of new neighbours is one more than the
   least value between them. After t steps, a window t bytes left of its sample repeats exactly if a
   neighbour's common prefix reaches `length`. All samples of a batch step left together.

Several lengths at once: samples are those of the shortest windows, and the contexts reach as far as the
longest need. Equal longer windows start with equal shorter ones, so they meet at the same samples.

Samples that occur more than `largest` times (a passage common to a large part of the corpus) don't meet
in one task: their windows' 128-bit hashes are counted by an aggregation instead, which combines on the
map side; the result is the same.

Texts are keyed by their content, so copies are sampled once a task and counted. Null texts are empty;
texts under `length` bytes lose nothing; an empty table gives no row; repeated rows count as repeats.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import cut, discard, few, stored, tasks, text_bytes

CHUNK = 1 << 19
MASK64 = (1 << 64) - 1
RUNS = "array<struct<len:int,t:int,stop:int>>"
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a value for each byte."""
    inverse = pow(BASE, -1, 1 << 64)
    ups = [np.cumprod(np.full(CHUNK + 1, b, np.uint64), dtype=np.uint64) * np.uint64(pow(b, -1, 1 << 64)) for b in (BASE, inverse)]
    table = np.random.default_rng(7).integers(0, MASK64, 256, dtype=np.uint64, endpoint=True)
    return ups[0], ups[1], table


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string of at most CHUNK bytes."""
    up, down, table = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(v) - w + 1
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, MASK64, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def samples(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each sample that a window of the text names."""
    a = np.frombuffer(raw, np.uint8)
    parts, w = [], length - gram + 1
    step = CHUNK - length
    for at in range(0, max(len(a) - length + 1, 0), step):
        part = a[at : min(at + step + length - 1, len(a))]
        h = gram_hashes(part, gram)
        # the place in the low bits: the leftmost of equal hashes is the least
        m = sliding_min((h & ~np.uint64(CHUNK - 1)) | np.arange(len(h), dtype=np.uint64), w)
        x = (m & np.uint64(CHUNK - 1)).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        last = np.append(turn[1:], len(x)) - 1
        parts.append((h[x[turn]], x[turn] + at, turn + at, last + at))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def common_prefix(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows of bytes: the common prefix of each with the one before (the first: 0), at most both sizes."""
    out = np.zeros(len(a), np.int16)
    if len(a) > 1:
        differs = a[1:] != a[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of v[lo:hi] for each pair, lo < hi."""
    span = hi - lo
    out = np.empty(len(lo), v.dtype)
    level, k, table = np.frexp(span)[1] - 1, 0, v
    top = int(level.max()) if len(level) else -1
    while k <= top:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if k < top:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1
    return out


def induce(left: np.ndarray, t_lo: np.ndarray, t_hi: np.ndarray, lcp: np.ndarray, number: np.ndarray, sizes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Which windows of samples in suffix order repeat: a matrix (sample, t) for each length.

    left[i, t - 1]: the byte t places left of sample i; lcp: common prefixes of neighbours at t = 0; sizes: of the suffixes.
    """
    n = len(t_lo)
    marks = [np.zeros((n, int(t_hi.max()) + 1), bool) for _ in lengths]
    order = np.arange(n)
    for t in range(int(t_hi.max()) + 1):
        if t:
            alive = np.flatnonzero(t_hi[order] >= t)
            byte = left[order[alive], t - 1]
            new = alive[np.argsort(byte, kind="stable")]
            fresh = np.zeros(len(new), lcp.dtype)
            byte = left[order[new], t - 1]
            same = np.flatnonzero(byte[1:] == byte[:-1])
            fresh[same + 1] = range_min(lcp, new[same] + 1, new[same + 1] + 1) + 1
            order, lcp = order[new], fresh
        for length, m in zip(lengths, marks, strict=True):
            near = lcp >= length
            near[:-1] |= near[1:]
            twice = (number[order] > 1) & (sizes[order] + t >= length)
            m[order[(near | twice) & (t_lo[order] <= t)], t] = True
    return marks


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def sample_texts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, sha, place, n) of docs (sha, raw): place packs the place and its windows' distances."""

    def run(batches):
        seen: dict[bytes, int] = {}  # copies in a task are counted, not sampled again
        held: dict[bytes, tuple] = {}

        def out():
            rows = [(k, v) for k, v in held.items() if len(v[0])]
            reps = [len(v[0]) for _, v in rows]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([v[0] for _, v in rows]).view(np.int64)),
                    pa.array([k for k, n in zip([k for k, _ in rows], reps, strict=True) for _ in range(n)], pa.binary()),
                    pa.array(np.concatenate([v[1] for _, v in rows])),
                    pa.array(np.repeat([seen[k] for k, _ in rows], reps), pa.int64()),
                ], names=["h", "sha", "place", "n"])
            seen.clear()
            held.clear()

        total = 0
        for b in batches:
            for sha, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(raw) < length:
                    continue
                seen[sha] = seen.get(sha, 0) + 1
                if sha not in held:
                    h, x, first, last = samples(raw, length, gram)
                    held[sha] = h, (x << 20) | ((x - last) << 10) | (x - first)
                    total += len(h)
            if total > 60_000:
                yield from out()
                total = 0
        yield from out()
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little

    return docs.mapInArrow(run, "h long, sha binary, place long, n long")


def unpack(place: int) -> tuple[int, int, int]:
    return place >> 20, (place >> 10) & 1023, place & 1023


def context(raw: bytes, place: int, length: int) -> tuple[bytes, int, int, int]:
    """(bytes that the windows of a sample need, its place, least and greatest distance of a window)."""
    x, lo, hi = unpack(place)
    return raw[x - hi : x - lo + length], x, lo, hi


def context_id(ctx: bytes, lo: int, hi: int) -> bytes:
    return hashlib.blake2b(ctx + bytes([lo & 255, lo >> 8, hi & 255, hi >> 8]), digest_size=16).digest()


def contexts(held: DataFrame, length: int) -> DataFrame:
    """(h, suffix, left, lo, hi, id, n): a row for each different context of a task. left is read backwards."""

    def run(batches):
        got: dict[bytes, list] = {}
        size = 0

        def out():
            v = list(got.values())
            if v:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in v], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["h", "suffix", "left", "lo", "hi", "id", "n"])
            got.clear()

        for b in batches:
            for raw, n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                for hit in hits:
                    if hit["hot"]:
                        continue
                    ctx, _, lo, hi = context(raw, hit["place"], length)
                    key = context_id(ctx, lo, hi)
                    if key in got:
                        got[key][6] += n
                    else:
                        got[key] = [hit["h"], ctx[hi:], ctx[:hi][::-1], lo, hi, key, n]
                        size += len(ctx) + 200
                if size > 8_000_000:
                    yield from out()
                    size = 0
        yield from out()
        pa.default_memory_pool().release_unused()

    return held.mapInArrow(run, "h long, suffix binary, left binary, lo int, hi int, id binary, n long")


def occurrences(held: DataFrame, length: int) -> DataFrame:
    """(id, sha, x): where each context lies."""

    def run(batches):
        for b in batches:
            ids, shas, xs = [], [], []
            for sha, raw, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                for hit in hits:
                    ctx, x, lo, hi = context(raw, hit["place"], length)
                    ids.append(context_id(ctx, lo, hi))
                    shas.append(sha)
                    xs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shas, pa.binary()), pa.array(xs, pa.int64())], names=["id", "sha", "x"])

    return held.mapInArrow(run, "id binary, sha binary, x long")


def hot_windows(held: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(id, t, len, w, n): each window of the samples that occur too often to meet in one task, by its hash."""

    def run(batches):
        def batch(rows):
            types = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "t", "len", "w", "n"])

        seen: dict[bytes, int] = {}  # equal contexts of a batch are counted
        for b in batches:
            seen.clear()
            at: dict[bytes, tuple] = {}
            for raw, n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                for hit in hits:
                    if hit["hot"]:
                        ctx, _, lo, hi = context(raw, hit["place"], lengths[-1])
                        key = context_id(ctx, lo, hi)
                        seen[key] = seen.get(key, 0) + n
                        at[key] = ctx, lo, hi
            rows = []
            for key, (ctx, lo, hi) in at.items():
                for length in lengths:
                    rows += [(key, t, length, hashlib.blake2b(ctx[hi - t : hi - t + length], digest_size=16).digest(), seen[key]) for t in range(lo, hi + 1) if hi - t + length <= len(ctx)]
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return held.mapInArrow(run, "id binary, t int, len int, w binary, n long")


def marked(ctx: DataFrame, lengths: tuple[int, ...], batch: int = 6000) -> DataFrame:
    """(id, runs): a row for each context, windows t to stop - 1 of which repeat. ctx is sorted by h and suffix."""
    longest = lengths[-1]

    def run(batches):
        def matrix(rows, column, width):
            a = np.zeros((len(rows), width), np.uint8)
            for i, r in enumerate(rows):
                b = r[column]
                a[i, : len(b)] = np.frombuffer(b, np.uint8)
            return a

        def merge(rows):
            """Equal contexts from several tasks become one. Their order is that of the suffixes."""
            at: dict[bytes, int] = {}
            out = []
            for r in rows:
                if r[5] in at:
                    out[at[r[5]]][6] += r[6]
                else:
                    at[r[5]] = len(out)
                    out.append(list(r))
            return out

        def work(rows):
            rows = merge(rows)
            right = matrix(rows, 1, longest)
            sizes = np.array([len(r[1]) for r in rows])
            lcp = common_prefix(right, sizes)
            lo, hi, n = (np.array([r[i] for r in rows]) for i in (3, 4, 6))
            found = induce(matrix(rows, 2, max(int(hi.max()), 1)), lo, hi, lcp, n, sizes, lengths)
            runs: dict[int, list[dict]] = {}
            for length, marks in zip(lengths, found, strict=True):
                for i in np.flatnonzero(marks.any(axis=1)).tolist():
                    runs.setdefault(i, []).extend({"len": length, "t": t, "stop": stop} for t, stop in runs_of(marks[i]))
            kind = pa.list_(pa.struct([("len", pa.int32()), ("t", pa.int32()), ("stop", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([rows[i][5] for i in runs], pa.binary()), pa.array(list(runs.values()), kind)], names=["id", "runs"])

        done, group = [], []  # whole groups so far, the open group
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group and group[0][0] != r[0]:
                    done += group if len(group) > 1 or group[0][6] > 1 else []
                    group = []
                    if len(done) >= batch:
                        yield work(done)
                        done = []
                group.append(r)
        done += group if len(group) > 1 or (group and group[0][6] > 1) else []
        if done:
            yield work(done)
        pa.default_memory_pool().release_unused()

    return ctx.mapInArrow(run, f"id binary, runs {RUNS}")


def hot_runs(windows: DataFrame) -> DataFrame:
    """(id, runs): the repeated windows (id, t, len) of each context as runs, so that an occurrence meets one row, not its windows."""
    ts = windows.groupBy("id", "len").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    first, last = F.filter("ts", lambda t: ~F.array_contains("ts", t - 1)), F.filter("ts", lambda t: ~F.array_contains("ts", t + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(F.col("len"), a.alias("t"), (b + 1).alias("stop")))
    return ts.select("id", runs.alias("runs")).groupBy("id").agg(F.flatten(F.collect_list("runs")).cast(RUNS).alias("runs"))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...], gram: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """docs (sha, raw) -> texts with a repeated sample (sha, raw, ...), and (sha, spans) of what repeats at each length."""
    lengths = tuple(sorted(set(lengths)))
    if not 0 < gram <= lengths[0] or lengths[0] - gram > 1023:
        raise ValueError("gram: from the least length - 1023 to it")
    spark = docs.sparkSession
    found = stored(sample_texts(docs, lengths[0], gram))
    # cut, so that both sides of the join are shuffled anew and Spark can split a hot sample's rows
    often = cut(found.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h", (F.col("n") > largest).alias("hot")))
    hits = stored(found.join(often, "h").groupBy("sha").agg(F.collect_set(F.struct("h", "place", "hot")).alias("hits")))
    discard(spark, found)
    # texts without a repeated sample stay where they are
    some = docs.join(few(hits.select(F.col("sha").alias("__s"))), F.col("sha") == F.col("__s"), "left_semi")
    texts = some.groupBy("sha").agg(F.first("raw").alias("raw"), F.count("*").alias("n"))
    held = stored(texts.join(hits, "sha").select("sha", "raw", "n", "hits"))
    discard(spark, hits)
    number = held.agg(F.sum(F.size("hits"))).first()[0] or 0
    ctx = contexts(held, lengths[-1]).repartition(tasks(spark, number, 25_000), "h").sortWithinPartitions("h", "suffix")
    per_row = stored(marked(ctx, lengths))
    discard(spark)
    if not often.filter("hot").isEmpty():
        hot = stored(hot_windows(held, lengths))
        # one row for each batch and window may carry a part of the number: sum them before the count is judged
        twice = hot.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w")
        per_row = per_row.union(stored(hot_runs(hot.join(twice, "w", "left_semi"))))
    # window t starts t bytes left of x: windows t..stop-1 cover x - (stop - 1) to x - t + length
    span = lambda r: F.struct(r["len"].alias("len"), (F.col("x") - r["stop"] + 1).alias("a"), (F.col("x") - r["t"] + r["len"]).alias("b"))
    cover = occurrences(held, lengths[-1]).join(per_row, "id").select("sha", F.transform("runs", span).alias("s"))
    return held, cover.groupBy("sha").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_parts(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    raw = text_bytes(text_col)
    return df.withColumns({"__sha": F.unhex(F.substring(F.sha2(raw, 256), 1, 32)), "__raw": raw})


def removals(df: DataFrame, text_col: str, length: int, also: int | None, gram: int, largest: int, with_text: bool) -> DataFrame:
    """(sha, n_removed, n_spans, kept_sha256, [kept], passage_bytes, passage_spans) of each different text with repeats."""
    docs = keyed(df.select(text_col), text_col).select(F.col("__sha").alias("sha"), F.col("__raw").alias("raw"))
    held, spans = repeated_spans(docs, (length,) if also is None else (length, also), gram, largest)

    def run(batches):
        for b in batches:
            rows = []
            for sha, raw, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                m = merged(x for x in s if x["len"] == length)
                p = merged(x for x in s if x["len"] == also)
                left = kept_parts(raw, m)
                rows.append((sha, len(raw) - len(left), len(m), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None, sum(y - x for x, y in p), len(p)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["sha", "n_removed", "n_spans", "kept_sha256", "kept", "passage_bytes", "passage_spans"])

    return held.select("sha", "raw").join(spans, "sha").mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha256 string, kept string, passage_bytes long, passage_spans long")


def repeats_table(df: DataFrame, length: int = 400, gram: int = 64, largest: int = 50_000, also: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each document loses, and the digest of what is left; also: what repeats at a second length, which stays."""
    lost = cut(removals(df, text_col, length, also, gram, largest, False).drop("kept"))
    raw = text_bytes(text_col)
    all_docs = df.select(F.col(id_col), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("full")).withColumn("__sha", F.unhex(F.substring("full", 1, 32)))
    j = all_docs.join(lost, F.col("__sha") == F.col("sha"), "left")
    zero = F.lit(0).cast("long")
    passages = [] if also is None else [F.coalesce(c, zero).alias(c) for c in ("passage_bytes", "passage_spans")]
    return j.select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "full").alias("kept_sha256"), *passages)


def remove_repeats(df: DataFrame, length: int = 400, gram: int = 64, largest: int = 50_000, text_col: str = "text") -> DataFrame:
    """df without the repeated bytes (a character that is cut in two goes too); rows and columns stay."""
    lost = stored(removals(df, text_col, length, None, gram, largest, True).select(F.col("sha").alias("__lost"), F.col("kept").alias("__kept")))
    j = keyed(df, text_col).join(lost, F.col("__sha") == F.col("__lost"), "left")
    return j.withColumn(text_col, F.when(F.col("__lost").isNotNull(), F.col("__kept")).otherwise(F.col(text_col))).select(*df.columns)
