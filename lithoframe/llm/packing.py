"""Order-preserving packing by dynamic programming.

The documents of a partition, in their order, form one stream of ids (each document ends with one
separator id). The stream is cut into windows of at most `size` ids. A window costs its padding; a cut
costs nothing between documents, `sentence_cost` after an id that ends a sentence, and `hard_cost`
elsewhere (exactly one window after a natural cut, and at steps inside sentences longer than half a
window). With candidate cuts c0 < c1 < ... the least cost
is f(j) = cost(j) + size - c_j + min(f(i) + c_i) over c_j - size <= c_i < c_j, a sliding minimum that a
monotone queue gives in constant time for each candidate.

The stream is worked off in blocks of `block` ids; the last windows of a block stay open and start the
next block, so only a partition's very last window is cut short. Documents don't move between
partitions: with `order_by`, the rows are range-partitioned and sorted first.

Null texts count as empty (the separator alone). Repeated rows are packed as often as they occur; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lithoframe.llm.bpe import read_ranks

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(4)
def tokenizer(path: str):
    """Loaded where a text needs it: a worker that never meets an added token keeps the ranks alone."""
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


class Tokens:
    """Ids of texts by a vocabulary file, and which ids end a sentence."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        if ranks_path:  # the same vocabulary as ranks gives the same ids several times as fast
            import tiktoken

            enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
            with open(path, encoding="utf-8") as f:
                added = {t["id"]: t["content"] for t in json.load(f).get("added_tokens", [])}  # tokens that the ranks don't have
            find = re.compile("|".join(map(re.escape, added.values())) or "(?!)").search
            self.encode = lambda t: tokenizer(path).encode(t, add_special_tokens=False).ids if find(t) else enc.encode_ordinary(t)
            texts = [enc.decode_single_token_bytes(i).decode("utf-8", "ignore") for i in range(enc.max_token_value + 1)]
            texts += [added.get(i, "") for i in range(len(texts), max(added, default=-1) + 1)]
        else:
            tok = tokenizer(path)
            self.encode = lambda t: tok.encode(t, add_special_tokens=False).ids
            texts = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())]
        self.ends = np.array([t.rstrip(" ")[-1:] in tuple(".!?\n") and bool(t.strip(" ")) for t in texts])


@lru_cache(4)
def tokens(path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    return Tokens(path, ranks_path, pattern)


def choose_cuts(candidates: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Indices of the candidates to cut at, first and last included. Gaps must not exceed size."""
    at, pen = candidates.tolist(), costs.tolist()
    n = len(at)
    best, back = [0] * n, [0] * n
    queue = deque([0])
    low = [0] * n  # best[i] + at[i]
    low[0] = at[0]
    for j in range(1, n):
        floor = at[j] - size
        while at[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        back[j] = i
        low[j] = v = pen[j] + size + low[i]
        while queue and low[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int, sentence_cost: int, hard_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to len(ids) and the cost of each."""
    inner = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    at = np.union1d(np.union1d(inner, doc_ends), [0, len(ids)])
    full = at + size
    at = np.union1d(at, full[full < len(ids)])
    long = np.flatnonzero(np.diff(at) > size // 2)
    if len(long):  # steps inside long sentences
        at = np.union1d(at, np.concatenate([np.arange(at[k], at[k + 1], max(size // 16, 1)) for k in long]))
    cost = np.full(len(at), hard_cost)
    cost[np.isin(at, inner)] = sentence_cost
    cost[np.isin(at, doc_ends)] = 0
    return at, cost


def pack(docs: Iterator[tuple], ends: np.ndarray, size: int, sentence_cost: int, hard_cost: int, block: int) -> Iterator[tuple]:
    """docs: (key, ids) in order. Yields (key, start, ids of the piece, doc_tokens, sequence, offset)."""
    held: list[tuple] = []  # (key, start, ids, doc_tokens)
    total, sequence = 0, 0

    def flush(last: bool):
        nonlocal held, total, sequence
        ids = np.concatenate([h[2] for h in held])
        stops = np.cumsum([len(h[2]) for h in held])
        at, cost = candidates(ids, stops, ends, size, sentence_cost, hard_cost)
        chosen = at[choose_cuts(at, cost, size)].tolist()
        keep = chosen[-1] if last else chosen[max(1, len(chosen) - 3)]
        rest, k, begun = [], 0, 0  # begun: where piece k starts in the block
        for a, b in zip(chosen, chosen[1:], strict=False):
            if b > keep:
                break
            while k < len(held) and begun < b:
                key, start, own, n = held[k]
                lo, hi = max(a, begun) - begun, min(b, begun + len(own)) - begun
                yield key, start + lo, own[lo:hi], n, sequence, begun + lo - a
                if begun + len(own) > b:
                    break
                begun += len(own)
                k += 1
            sequence += 1
        for key, start, own, n in held[k:]:
            lo = max(keep - begun, 0)
            if lo < len(own):
                rest.append((key, start + lo, own[lo:], n))
            begun += len(own)
        held, total = rest, sum(len(r[2]) for r in rest)

    for key, ids in docs:
        held.append((key, 0, ids, len(ids)))
        total += len(ids)
        if total >= block:
            yield from flush(False)
    if held:
        yield from flush(True)


def pack_documents(df: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 1024, separator: int = 0, sentence_cost: int = 4, hard_cost: int = 16, block: int = 1 << 20, order_by: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; with_ids adds the piece's ids. sequence_id is unique over partitions."""
    if order_by:
        df = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokens(path, ranks_path, pattern)
        base = TaskContext.get().partitionId() << 32
        key_type = None

        def docs():
            nonlocal key_type
            for b in batches:
                key_type = b.column(0).type
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = t.encode(text) if text else []
                    ids.append(separator)
                    yield key, np.array(ids, dtype="<u4")

        def batch(rows):
            cols = [pa.array([r[0] for r in rows], key_type)]
            cols += [pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].tobytes()) for r in rows], [r[3] for r in rows], [base + r[4] for r in rows], [r[5] for r in rows])]
            cols += [pa.array([r[2].astype("i4") for r in rows], pa.list_(pa.int32()))] if with_ids else []
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] * with_ids)])

        rows = []
        for r in pack(docs(), t.ends, size, sentence_cost, hard_cost, block):
            rows.append(r)
            if len(rows) >= 8192:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {PIECE}" + ", ids array<int>" * with_ids)
