"""TIFF columns: one row per page.

The reader walks the chain of image directories (classic and 64-bit files, either byte order), decodes
uncompressed, PackBits, LZW and deflate data in strips or tiles, undoes prediction (horizontal, floating point), and
joins the parts to row-major samples of 1 to 32 bits. A page that can't be read gives a row with the error, a file
without a first directory one with page -1; a null file gives no row. No strip is decompressed beyond what its page
says, and no page beyond a limit. Extra columns are kept unless they clash with the page columns, which win.

The writer is the other direction, for lossless storage of bytes as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import to_batch

# fixed values of the file format
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_LEN, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_LEN = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q"}
CLEAR, END, FIRST, FULL = 256, 257, 258, 4094
MOST = 1 << 28  # bytes of a page's samples; larger ones give an error row


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


# ---- LZW: the width of the k-th code after a clear code depends on k alone


@lru_cache(1)
def _widths() -> tuple[np.ndarray, np.ndarray]:
    free = FIRST + np.maximum(np.arange(FULL - FIRST + 3) - 1, 0)
    w = 9 + (free > 510).astype(np.int64) + (free > 1022) + (free > 2046)
    return w, np.concatenate([[0], np.cumsum(w)])


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """The decoded bytes, `most` at most (what stands between two clear codes is a few megabytes at most)."""
    widths, starts = _widths()
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    bits, at, out, done = len(data) * 8, 0, [], 0
    while at + 9 <= bits and (most is None or done < most):
        n = int(np.searchsorted(starts[1:], bits - at, "right"))
        o = at + starts[:n]
        b = o >> 3
        v = (raw[b] << 16) | (raw[b + 1] << 8) | raw[b + 2]
        codes = (v >> (24 - widths[:n] - (o & 7))) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        k = int(stops[0]) if len(stops) else n
        if k:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            prev = None
            for c in codes[:k].tolist():
                if prev is None:
                    entry = table[c]
                else:
                    entry = table[c] if c < len(table) else prev + prev[:1]
                    table.append(prev + entry[:1])
                out.append(entry)
                done += len(entry)
                prev = entry
        if not len(stops):
            if n == len(widths):
                raise ValueError("LZW table overflows")
            break
        if codes[k] == END:
            break
        at += int(starts[k + 1])
    return b"".join(out)[:most]


def lzw_encode(data: bytes) -> bytes:
    codes, counts = [CLEAR], [0]
    table: dict[int, int] = {}
    free, code, k = FIRST, -1, 0
    for c in data:
        key = (code << 8) | c
        if code < 0:
            code = c
        elif (nxt := table.get(key)) is not None:
            code = nxt
        else:
            codes.append(code)
            counts.append(k)
            k += 1
            table[key] = free
            free += 1
            code = c
            if free == FULL:
                codes.append(CLEAR)
                counts.append(k)
                table, free, k = {}, FIRST, 0
    if code >= 0:
        codes.append(code)
        counts.append(k)
        k += 1
    codes.append(END)
    counts.append(k)
    w = _widths()[0][np.array(counts)]
    place = np.arange(12)
    bit = (np.array(codes)[:, None] >> np.maximum(w[:, None] - 1 - place, 0)) & 1
    return np.packbits(bit[place < w[:, None]].astype(np.uint8)).tobytes()


# ---- PackBits


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)[:most]


def packbits_encode(row: bytes) -> bytes:
    """One row: runs of three or more as runs, the rest as literals."""
    a = np.frombuffer(row, np.uint8)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]).tolist()
    out, lit = [], 0

    def literals(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = row[i : min(i + 128, hi)]
            out.append(bytes([len(part) - 1]) + part)

    for lo, hi in zip(cut, cut[1:], strict=False):
        if hi - lo >= 3:
            literals(lit, lo)
            for i in range(lo, hi, 128):
                n = min(128, hi - i)
                out.append(bytes([257 - n if n > 1 else 0]) + row[lo : lo + 1])
            lit = hi
    literals(lit, len(row))
    return b"".join(out)


def packbits_rows(rows: np.ndarray) -> bytes:
    """Each row by itself, as the format asks; rows without runs take the short way."""
    n, w = rows.shape
    plain = np.ones(n, bool) if w < 3 else ~((rows[:, :-2] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, 2:])).any(axis=1)
    return b"".join([bytes([w - 1]) + r.tobytes() if ok and w <= 128 else packbits_encode(r.tobytes()) for r, ok in zip(rows, plain.tolist(), strict=True)])


def compress(rows: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        rows = np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1), np.uint8))
    if compression == PACKBITS:
        return packbits_rows(rows)
    raw = rows.tobytes()
    return raw if compression == NONE else lzw_encode(raw) if compression == LZW else zlib.compress(raw, 1)


def decompress(data: bytes, compression: int, most: int) -> bytes:
    """At most `most` bytes, so that a crafted strip can't fill the memory."""
    if compression == NONE:
        return data[:most]
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    raise ValueError(f"compression {compression}")


# ---- files


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, width: int = 64, page_rows: int = 16384, strip_rows: int = 4096, tile: int = 1024) -> bytes:
    """payload (a positive multiple of width) as 8-bit grey pages of at most page_rows rows, little-endian."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = [struct.pack("<2sHI", b"II", 42, 8)]
    at = 8
    pages = [image[i : i + page_rows] for i in range(0, len(image), page_rows)]
    for k, rows in enumerate(pages):
        parts = []
        if tiled:
            tw = -(-width // 16) * 16
            for i in range(0, len(rows), tile):
                full = np.zeros((tile, tw), np.uint8)
                part = rows[i : i + tile]
                full[: len(part), :width] = part
                parts.append(compress(full, compression, predictor))
        else:
            parts = [compress(rows[i : i + strip_rows], compression, predictor) for i in range(0, len(rows), strip_rows)]
        n = len(parts)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [len(rows)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_W, 4, [tw]), (TILE_H, 4, [tile]), (TILE_AT, 4, [0] * n), (TILE_LEN, 4, [len(p) for p in parts])] if tiled else [(STRIP_AT, 4, [0] * n), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_LEN, 4, [len(p) for p in parts])]
        tags.sort()
        head = 2 + 12 * len(tags) + 4
        data_at = at + head + sum(4 * len(v) for _, t, v in tags if t == 4 and len(v) > 1)
        ends = np.cumsum([data_at, *map(len, parts)]).tolist()
        extra, extra_at, fields = b"", at + head, b""
        for tag, kind, v in tags:
            v = ends[:-1] if tag in (STRIP_AT, TILE_AT) else v
            raw = struct.pack(f"<{len(v)}{TYPES[kind]}", *v)
            if len(raw) > 4:
                fields += struct.pack("<HHII", tag, kind, len(v), extra_at + len(extra))
                extra += raw
            else:
                fields += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        nxt = ends[-1] + ends[-1] % 2
        out.append(struct.pack("<H", len(tags)) + fields + struct.pack("<I", nxt if k + 1 < len(pages) else 0) + extra + b"".join(parts) + b"\0" * (ends[-1] % 2))
        at = nxt
    return b"".join(out)


def read_directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    off, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    (at,) = struct.unpack_from(order + off, data, 8 if big else 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(count)
        tags = {}
        for i in range(n):
            e = at + i * entry
            tag, kind = struct.unpack_from(order + "HH", data, e)
            (num,) = struct.unpack_from(order + off, data, e + 4)
            if kind not in TYPES:
                continue
            inline = e + (12 if big else 8)
            if struct.calcsize(TYPES[kind]) * num > struct.calcsize(off):
                (inline,) = struct.unpack_from(order + off, data, inline)
            tags[tag] = list(struct.unpack_from(f"{order}{num}{TYPES[kind]}", data, inline))
        yield tags
        (at,) = struct.unpack_from(order + off, data, at + n * entry)


def samples_of(raw: bytes, rows: int, row_samples: int, bits: int, order: str) -> np.ndarray:
    """(rows, row_samples) of a strip's or tile's bytes; rows of 1, 2 and 4 bit samples end at whole bytes."""
    if bits >= 8:
        return np.frombuffer(raw, np.dtype(np.uint8 if bits == 8 else f"{order}u{bits // 8}"), count=rows * row_samples).reshape(rows, row_samples)
    width = -(-row_samples * bits // 8)
    packed = np.frombuffer(raw, np.uint8, count=rows * width).reshape(rows, width)
    each = np.unpackbits(packed, axis=1).reshape(rows, -1, bits)
    return (each @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).astype(np.uint8)[:, :row_samples]


def undo_predictor(part: np.ndarray, predictor: int, inner: int, order: str) -> np.ndarray:
    rows = len(part)
    if predictor == 2:  # differences to the sample one pixel to the left
        return np.cumsum(part.reshape(rows, -1, inner), axis=1, dtype=part.dtype.newbyteorder("=")).reshape(rows, -1)
    if predictor == 3:  # byte differences over the row's bytes in planes, the highest first
        wide = part.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(part).view(np.uint8).reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, wide, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{wide}").reshape(rows, -1).astype(f"{order}u{wide}")
    return part


def read_page(data: bytes, k: int, tags: dict[int, list[int]], most: int = MOST) -> Page:
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    samples, bits = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])[0]
    compression, predictor, planar = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0], tags.get(PLANAR, [1])[0]
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, [1]))) > 1 or predictor not in (1, 2, 3) or (predictor == 2 and bits < 8) or (predictor == 3 and bits < 16):
        raise ValueError(f"{bits} bits a sample, predictor {predictor}")
    order = "<" if data[:2] == b"II" else ">"
    tiled = TILE_W in tags
    pw, ph = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (w, min(tags.get(ROWS_PER_STRIP, [h])[0], h))
    if min(w, h, pw, ph, samples) < 1:
        raise ValueError("an empty page")
    at, size = (tags[TILE_AT], tags[TILE_LEN]) if tiled else (tags[STRIP_AT], tags[STRIP_LEN])
    across, down = -(-w // pw), -(-h // ph)
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    bytes_each = max(bits // 8, 1)
    if planes * down * ph * across * pw * inner * bytes_each > most:
        raise ValueError(f"a page of more than {most} bytes")
    if len(at) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    image = np.zeros((planes, down * ph, across * pw, inner), np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
    for i, (a, n) in enumerate(zip(at[: planes * across * down], size, strict=False)):
        plane, rest = divmod(i, across * down)
        y, x = divmod(rest, across)
        rows = ph if tiled else min(ph, h - y * ph)
        raw = decompress(data[a : a + n], compression, rows * -(-pw * inner * bits // 8))
        part = undo_predictor(samples_of(raw, rows, pw * inner, bits, order), predictor, inner, order)
        image[plane, y * ph : y * ph + rows, x * pw : (x + 1) * pw] = part.reshape(rows, pw, inner)
    image = image[:, :h, :w]
    image = image[0] if planes == 1 else image[..., 0].transpose(1, 2, 0)
    return Page(k, w, h, samples, bits, compression, predictor, tiled, np.ascontiguousarray(image).tobytes())


BROKEN = (ValueError, KeyError, struct.error, zlib.error, IndexError, MemoryError, OverflowError)


def read_tiff(data: bytes) -> Iterator[Page]:
    for k, tags in enumerate(read_directories(data)):
        yield read_page(data, k, tags)


def page_rows(data: bytes, most: int) -> list[dict]:
    """A row for each page, with an error where it can't be read; the others stay. A broken directory ends the walk."""
    rows, none = [], dict.fromkeys(Page._fields)
    try:
        for k, tags in enumerate(read_directories(data)):
            try:
                rows.append(read_page(data, k, tags, most)._asdict() | {"error": None})
            except BROKEN as e:
                rows.append(none | {"page": k, "error": f"{type(e).__name__}: {e}"})
    except BROKEN as e:
        rows.append(none | {"page": len(rows) or -1, "error": f"{type(e).__name__}: {e}"})
    return rows


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary"


def tiff_pages(df: DataFrame, content_col: str, most: int = MOST) -> DataFrame:
    """One row per page of each file, with the other columns of its row and an error string (null if read).

    Samples of 1, 2 and 4 bits come as a byte each, those of 16 and 32 bits in the file's byte order. Pages of more than
    `most` bytes, other sample sizes and other compressions give an error row. Null files give no row.
    """

    @F.arrow_udf(f"array<struct<{PAGE.replace(' int', ':int').replace(' boolean', ':boolean').replace(' binary', ':binary')},error:string>>")
    def pages(files: pa.Array) -> pa.Array:
        out = [None if f is None else page_rows(f, most) for f in files.to_pylist()]
        i, b = pa.int32(), pa.bool_()
        return pa.array(out, pa.list_(pa.struct([*[(n, i) for n in Page._fields[:7]], ("tiled", b), ("pixels", pa.binary()), ("error", pa.string())])))

    own = {*Page._fields, "error", content_col}
    return df.select(*[c for c in df.columns if c.lower() not in own], F.explode(pages(content_col)).alias("_p")).select("*", "_p.*").drop("_p")


def layout(payload: bytes) -> dict:
    """How a payload is stored: its checksum picks one of eight layouts, so equal payloads are stored alike."""
    k = zlib.crc32(payload) % 8
    choices = [(NONE, 1, False), (PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 1, True), (DEFLATE, 2, False), (DEFLATE, 2, True), (DEFLATE_OLD, 1, False), (PACKBITS, 1, True)]
    return dict(zip(("compression", "predictor", "tiled"), choices[k], strict=True), tile=64)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text (null: empty), zero-padded to a positive multiple of 64, as TIFF, read it back and describe it.

    Rows: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = write_tiff(payload, **layout(payload))
        pages = list(read_tiff(media))
        back = b"".join([p.pixels for p in pages])
        a = np.frombuffer(back, np.uint8)
        used = np.flatnonzero(np.bincount(a, minlength=256))
        p = pages[0]
        feature = f"pages={len(pages)} width={p.width} rows={sum(x.height for x in pages)} compression={p.compression} predictor={p.predictor} tiled={int(p.tiled)} sum={int(a.sum(dtype=np.int64))} min={used[0]} max={used[-1]} values={len(used)}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for b in batches:
            rows = [one(t) for t in b.column(1).to_pylist()]
            out = to_batch({k: [r[i] for r in rows] for i, k in enumerate(types)}, types)
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=[id_col, *types])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
