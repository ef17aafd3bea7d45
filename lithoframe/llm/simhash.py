"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits: some block of bits holds at least one of the differences or none is
needed, so with one block masked out at most two differences are left, and each side reaches a common
value by flipping at most one bit. Every distinct fingerprint therefore emits, for each of `blocks`
blocks, its masked value and all variants of it at one flipped bit (half the radius); variants are
shuffled, fingerprints that meet are deduplicated and verified by their true distance. Within a meeting
group and within a task only a spanning forest of the verified links goes on, so no group emits all its
pairs, and no link between groups is lost. Components come from alternating star contraction, cut at
each round.

Texts without a word have fingerprint zero; null texts count as such. Null ids don't become a component's
id unless it has no other. Repeated rows get equal results; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithoframe.llm.common import cut, few, stored, tasks


def fingerprint(text: str | None, words: int, seed: int) -> int:
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every whole text."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, fp long")


def variants(fps: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners) of unsigned fingerprints."""
    keys, width = [], 64 // blocks
    for j in range(blocks):
        lo, hi = j * width, 64 if j == blocks - 1 else (j + 1) * width
        mask = np.uint64(((1 << (hi - lo)) - 1) << lo)
        rest = (fps & ~mask) | (np.uint64(j) << np.uint64(lo))
        keys.append(rest)
        keys += [rest ^ np.uint64(1 << b) for b in range(64) if not lo <= b < hi]
    return np.concatenate(keys), np.tile(fps, len(keys))


class Forest:
    """Union-find that remembers which links joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def near_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within radius among fingerprints that share a key."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[fresh], fps[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    forest = Forest()
    two = starts[sizes == 2]
    near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
    pairs = np.unique(np.stack([fps[near], fps[near + 1]], axis=1), axis=0) if len(near) else np.empty((0, 2), np.uint64)
    for a, b in pairs.tolist():
        forest.link(a, b)
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        left = fps[s : s + n]
        if len({forest.find(x) for x in left.tolist()}) == 1 and n <= 64:
            continue  # joined by verified links already
        while len(left):  # walk each cluster once; only its tree's links are kept
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                close = np.bitwise_count(left ^ x) <= radius
                got = left[close]
                left = left[~close]
                for y in got.tolist():
                    forest.link(int(x), y)
                queue.extend(got)
    return forest.links


def links(nodes: DataFrame, rows: int, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(a, b): verified links that join all fingerprints (fp) of nodes that are reachable within radius."""
    if radius // 2 > 1 or radius - 2 * (radius // 2) > 1:
        raise ValueError("radius: 2 or 3")

    def emit(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 8192):
                k, o = variants(fps[i : i + 8192], blocks)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(o.view(np.int64))], names=["k", "fp"])

    def meet(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            k, f = (np.concatenate([g[i] for g in got]).view(np.uint64) for i in (0, 1))
            found = np.array(near_links(k, f, radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    emitted = nodes.select("fp").mapInArrow(emit, "k long, fp long")
    n = tasks(nodes.sparkSession, rows * (64 * (blocks - 1) + blocks), 2_000_000)
    return emitted.repartition(n, "k").mapInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node that it reaches; large-star and small-star rounds."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, blocks: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id among all documents whose fingerprints are reachable by links."""
    prints = cut(fingerprints(df, words, seed, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    e = cut(links(nodes, nodes.count(), radius, blocks))
    roots = components(e)
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def fingerprint_table(df: DataFrame, **options) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id)."""
    return near_duplicates(df, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near-duplicates by similarity of word shingles: several short fingerprints

MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
WIDE = 64  # bits of a node's id, which are compared where nodes meet
#: members of a meeting group: up to PAIRED all pairs are met, up to TREED a nearest-neighbour tree, else PROBES of them search
PAIRED, TREED, PROBES = 9, 64, 64
NEAR = 24  # met pairs of a node that are compared at once


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """The different shingles of a text, hashed."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    parts = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, seed) for p in parts], np.uint64))


def signature(h: np.ndarray, streams: int) -> bytes:
    """One SimHash of 64 bits for each of `streams` mixings of the shingles' hashes."""
    out = []
    for j in range(streams):
        v = h + np.uint64((j * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        for m in MIX:
            v = (v ^ (v >> np.uint64(33))) * np.uint64(m)
        v ^= v >> np.uint64(33)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(v), 1 << 15):
            part = v[i : i + (1 << 15)].astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


class Bound:
    """What a similarity of percent / 100 or more means for bits, overlaps and sizes; and how many tables find it.

    measure: 'jaccard' (shared shingles of all) or 'cosine' (shared shingles of the geometric mean), which is the
    similarity whose angle SimHash measures. A bit of two texts differs with the chance angle / pi.
    """

    def __init__(self, measure: str, percent: int, rows: int, recall: float):
        if measure not in ("jaccard", "cosine") or not 0 < percent <= 100:
            raise ValueError("measure: jaccard or cosine; percent: 1 to 100")
        self.measure, self.percent, t = measure, percent, percent / 100
        low, high = (2 * t / (1 + t), math.sqrt(t)) if measure == "jaccard" else (t, t)  # cosines at the bound
        chance = math.acos(low) / math.pi
        # random texts share a key of `bits` bits and one-bit balls with one or two others, at any number of rows
        self.bits = max(21, math.ceil(math.log2(max(rows, 2))) + 3)
        met = sum(math.comb(self.bits, k) * chance**k * (1 - chance) ** (self.bits - k) for k in range(3))
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1
        self.streams = -(-(WIDE + self.tables * self.bits) // 64)
        self.check = math.floor(self.limit(WIDE, low, 3))
        self.sure, self.doubtful = self.limit(64 * self.streams, high, -4), self.limit(64 * self.streams, low, 4)

    @staticmethod
    def limit(bits: int, cosine: float, sigmas: float) -> float:
        p = math.acos(cosine) / math.pi
        return bits * p + sigmas * math.sqrt(bits * p * (1 - p))

    def holds(self, both: Column, a: Column, b: Column) -> Column:
        """Whether `both` shared of a and b shingles are enough, in whole numbers."""
        p = self.percent
        if self.measure == "jaccard":
            return 100 * both >= p * (a + b - both)
        return 10_000 * both.cast("long") * both >= p * p * a.cast("long") * b

    def smallest(self, larger: Column) -> Column:
        """The least size that a set similar to one of `larger` has."""
        p = self.percent
        return F.ceil(larger * p / 100) if self.measure == "jaccard" else F.ceil(larger.cast("long") * p * p / 10_000)

    def prefixes(self, n: Column) -> tuple[Column, Column]:
        """(of the larger set, of the smaller): so many of the rarest shingles; similar sets share one of them."""
        p = self.percent
        same = F.ceil(n * 2 * p / (100 + p)) if self.measure == "jaccard" else F.ceil(n * p / 100)
        return n - self.smallest(n) + 1, n - same + 1


def nearest_tree(check: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """For fingerprints that share a key: each but the first with the nearest one before it in the tree, if within `limit` bits."""
    n = len(check)
    best, of = np.full(n, 65, np.int16), np.zeros(n, np.int64)
    left = np.arange(1, n)
    out, x = [], 0
    while len(left):
        d = np.bitwise_count(check[left] ^ check[x]).astype(np.int16)
        nearer = d < best[left]
        best[left[nearer]], of[left[nearer]] = d[nearer], x
        k = int(best[left].argmin())
        x = int(left[k])
        if best[x] <= limit:
            out.append((int(of[x]), x))
        left = np.delete(left, k)
    return out


def probed(check: np.ndarray, key: int, limit: int) -> list[tuple[int, int]]:
    """For a large group: the nearest neighbours of PROBES members, chosen by a hash of member and key."""
    order = (check ^ np.uint64(key)) * np.uint64(MIX[0])
    out = []
    for x in np.argpartition(order, PROBES)[:PROBES].tolist():
        d = np.bitwise_count(check ^ check[x])
        d[x] = 255
        y = int(d.argmin())
        if d[y] <= limit:
            out.append((x, y))
    return out


def met_pairs(k: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs (n, 2) of nodes that share a key, their distances, members of groups of which pairs were left out)."""
    order = np.argsort(k, kind="stable")
    k, ids = k[order], ids[order]
    c = ids.view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    size = np.repeat(sizes, sizes)
    found, members = [], [ids[:0]]
    for step in range(1, PAIRED):
        i = np.flatnonzero((k[step:] == k[:-step]) & (size[step:] <= PAIRED))
        i = i[np.bitwise_count(c[i] ^ c[i + step]) <= limit]
        found.append(np.stack([ids[i], ids[i + step]], axis=1))
    for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
        own = c[s : s + n]
        tree = np.array(nearest_tree(own, limit) if n <= TREED else probed(own, int(k[s]) & ((1 << 64) - 1), limit), np.int64).reshape(-1, 2)
        found.append(ids[s:][tree])
        # the tree is a least one, so members without an edge have no neighbour within the limit
        members.append(ids[s + (np.unique(tree) if n <= TREED else np.arange(n))])
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    u = pairs.view(np.uint64)
    return pairs, np.bitwise_count(u[:, 0] ^ u[:, 1]).astype(np.int64), np.unique(np.concatenate(members))


def candidate_pairs(nodes: DataFrame, rows: int, bound: Bound) -> tuple[DataFrame, DataFrame]:
    """(a, b): different nodes (id, sig) that meet within two bits of one of the short fingerprints; (id): open nodes.

    Each short fingerprint emits itself and all variants at one bit, half the radius. Of a meeting group of more than
    PAIRED members a nearest-neighbour tree goes on (of more than TREED a bounded number of pairs), and of all pairs the
    NEAR nearest of each node, so that pairs and time grow with the nodes and not with the square of a group. Nodes of which pairs are left out are open: `rare_pairs` gives
    every similar pair of them that links don't join.
    """
    tables, bits, streams, limit = bound.tables, bound.bits, bound.streams, bound.check

    def emit(batches):
        flips = np.array([0, *[1 << i for i in range(bits)]], np.uint64)
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for b in batches:
            ids = b.column(0).to_numpy()  # a node's id is its first 64 bits
            bit = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, streams * 8), axis=1)
            for t in range(tables):
                v = (bit[:, WIDE + t * bits : WIDE + (t + 1) * bits].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
                keys = (v[:, None] ^ flips) | np.uint64(t << bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bits + 1))], names=["k", "id"])

    def meet(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not got:
            return
        pairs, d, members = met_pairs(*(np.concatenate([g[j] for g in got]) for j in range(2)), limit)
        none = pa.nulls(len(members), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(d)], names=["a", "b", "d"])
        yield pa.RecordBatch.from_arrays([pa.array(members), none, none], names=["a", "b", "d"])
        pa.default_memory_pool().release_unused()

    n = tasks(nodes.sparkSession, rows * tables * (bits + 1), 500_000)
    met = stored(nodes.select("id", "sig").mapInArrow(emit, "k long, id long").repartition(n, "k").mapInArrow(meet, "a long, b long, d long"))
    pairs = met.filter("b is not null").distinct()
    sides = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d"))
    ranked = stored(sides.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("rank") <= NEAR + 1))
    kept = ranked.filter(F.col("rank") <= NEAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return kept, met.filter("b is null").select(F.col("a").alias("id")).union(ranked.filter(F.col("rank") > NEAR).select("a")).distinct()


def rare_pairs(sets: DataFrame, bound: Bound) -> DataFrame:
    """(a, b): every pair of sets (id, root, s) of different roots that can be similar; complete.

    Shingles that sets of different roots share are put in the order of their frequency, after all others. Two similar
    sets of different roots share one of the first shingles of the smaller that is among the first of the larger (see
    `Bound.prefixes`). What a whole family of texts shares stands last, so a family that isn't similar gives no pairs.
    """
    n = F.size("s")
    words = sets.select("id", "root", F.explode("s").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("w", "f")
    shared = words.select("id", "w").join(often, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("o"))
    long, short = bound.prefixes(n)
    alone = n - F.size("o")  # these come first in the order
    first = lambda m: F.transform(F.slice("o", 1, F.greatest(m - alone, F.lit(0)).cast("int")), lambda x: x["w"])
    p = stored(sets.join(shared, "id").select("id", "root", n.alias("n"), alone.alias("at"), first(long).alias("long"), first(short).alias("short")))
    side = lambda i, o: p.select(F.col("id").alias(i), F.col("root").alias(f"root_{i}"), F.col("n").alias(f"n_{i}"), F.col("at").alias(f"at_{i}"), F.posexplode(o).alias(f"p_{i}", "w"))
    # the first word that a similar pair shares stands so early on both sides that enough can follow
    spare = lambda i: F.col(f"n_{i}") - F.col(f"at_{i}") - F.col(f"p_{i}")
    fits = (F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "a") < F.struct("n_b", "b")) & bound.holds(F.least(spare("a"), spare("b")), F.col("n_a"), F.col("n_b"))
    return side("a", "short").join(side("b", "long"), "w").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def similar_groups(df: DataFrame, words: int = 5, percent: int = 80, measure: str = "jaccard", recall: float = 0.97, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, component_id, first): groups of documents linked by a similarity of word shingles of percent / 100 or more.

    Candidates by short fingerprints, as many that a pair at the bound meets with a chance of `recall`; pairs whose long
    signatures are four deviations off the bound are links or none, the others are compared by their shingles (32 bits
    of each one's hash). first: whether a row has its group's smallest (id, hash).
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.count()
    bound = Bound(measure, percent, rows, recall)
    streams = bound.streams

    def sign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([signature(shingle_hashes(t, words, seed), streams) for t in b.column(2).to_pylist()], pa.binary())], names=[id_col, "th", "sig"])

    th = text_hash(text_col).alias("th")
    signed = stored(df.select(id_col, th, text_col).mapInArrow(sign, f"{id_col} {kind}, th long, sig binary").withColumn("id", F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")))
    # documents with the same first 64 bits are one node: at a similarity of 0.8 that has a chance of 3 in 100,000 (jaccard), 4 in 10,000,000 (cosine)
    first = F.struct(F.col(id_col).alias("i"), F.col("th").alias("h"))
    nodes = stored(signed.groupBy("id").agg(F.coalesce(F.min_by("sig", id_col), F.first("sig")).alias("sig"), F.coalesce(F.min_by("th", id_col), F.first("th")).alias("th"), F.min(F.when(F.col(id_col).isNotNull(), first)).alias("first")))
    pairs, members = candidate_pairs(nodes, rows, bound)
    sig = lambda x: nodes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))

    def distance(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, streams * 8) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))], names=["a", "b", "d"])

    judged = stored(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(distance, "a long, b long, d int").filter(F.col("d") <= bound.doubtful))
    sure, doubtful = judged.filter(F.col("d") <= bound.sure).select("a", "b"), judged.filter(F.col("d") > bound.sure).select("a", "b")

    # the shingles of every node that is in question
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("id")).union(members).distinct()
    which = few(nodes.join(asked, "id", "left_semi").select("id", F.col("th").alias("__h")))

    def shingles(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, words, seed).astype(np.uint32)).view(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "s"])

    texts = df.select(th, F.col(text_col).alias("t")).join(which, F.col("th") == F.col("__h")).select("id", "t")
    # equal rows bring equal sets
    sets = stored(texts.mapInArrow(shingles, "id long, s array<int>").groupBy("id").agg(F.first("s").alias("s")))

    def verified(x: DataFrame) -> DataFrame:
        side = lambda i: sets.select(F.col("id").alias(i), F.col("s").alias(f"s_{i}"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        return x.join(side("a"), "a").join(side("b"), "b").filter(bound.holds(both, F.size("s_a"), F.size("s_b"))).select("a", "b")

    roots = components(sure.unionByName(verified(doubtful)))

    def rooted(x: DataFrame, i: str) -> DataFrame:
        return x.join(roots.select(F.col("node").alias(i), F.col("root").alias("__r")), i, "left").withColumn(f"root_{i}", F.coalesce("__r", i)).drop("__r")

    # open nodes that these links don't join: every pair that can be similar
    more = stored(rare_pairs(sets.join(rooted(members, "id"), "id").select("id", F.col("root_id").alias("root"), "s"), bound))
    links = rooted(rooted(verified(more), "a"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = components(links)  # of roots
    last = rooted(nodes.select("id", "first"), "id").join(joined.withColumnsRenamed({"node": "root_id", "root": "__j"}), "root_id", "left")
    every = last.select("id", "first", F.coalesce("__j", "root_id").alias("root_id"))
    # nodes stay where they are; groups of more than one, however large, become a row each
    least = every.groupBy("root_id").agg(F.min("first").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("root_id").alias("__g"), "least")
    own = every.join(few(least), F.col("root_id") == F.col("__g"), "left").select("id", F.when(F.col("__g").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"))
    grouped = signed.join(own, "id")
    return grouped.select(id_col, F.col("th").alias("text_hash"), F.col("least.i").alias("component_id"), ((F.col(id_col) == F.col("least.i")) & (F.col("th") == F.col("least.h"))).alias("first"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, measure: str = "jaccard", recall: float = 0.97) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns. Rows without an id stay.

    Different texts under one id are different documents; of equal rows one stays. Texts move only where the rows that
    go are too many to be broadcast, or equal rows have to meet.
    """
    near = stored(similar_groups(df, words, percent, measure, recall).filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.max(F.coalesce("first", F.lit(False))).alias("first"), F.count("*").alias("n")))
    key = ["doc_id", "text_hash"]
    keyed = df.withColumn("__th", text_hash("text"))

    def of(which: DataFrame, how: str) -> DataFrame:
        w = few(which.select(*[F.col(k).alias(f"__{k}") for k in key]))
        return keyed.join(w, (F.col("doc_id") == F.col("__doc_id")) & (F.col("__th") == F.col("__text_hash")), how)

    many = near.filter("first and n > 1")
    out = of(near.filter("not first or n > 1"), "left_anti")
    if not many.isEmpty():
        out = out.unionByName(of(many, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return out.select(*df.columns)
