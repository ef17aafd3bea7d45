"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every vocabulary entry becomes a piece whose characters stand for its bytes (one printable character
for each byte), its score is minus its rank, and normalisation is the identity, so the library's merge
order is the rank order. A pre-token that is itself an entry is taken whole; others are merged.
Decoding maps each piece's characters back to bytes.

Null texts count as empty: no token, hashes of nothing. Other columns don't matter to the result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lithoframe.llm.common import Memo, to_batch, units


@lru_cache(1)
def byte_chars() -> list[str]:
    """One printable character for each byte: itself where it prints, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model of a rank table; piece i is the entry of rank i."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_chars()
    model = pb.ModelProto()
    by_rank = {r: t for t, r in ranks.items()}
    for rank in range(max(by_rank) + 1):
        token = by_rank.get(rank)
        piece = "".join(chars[b] for b in token) if token is not None else f"{rank}"
        kind = pb.ModelProto.SentencePiece.NORMAL if token is not None else pb.ModelProto.SentencePiece.UNUSED
        model.pieces.add(piece=piece, score=-float(rank), type=kind)
    model.pieces.add(piece="unk", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_id = pb.TrainerSpec.BPE, len(model.pieces), len(model.pieces) - 1
    t.bos_id = t.eos_id = t.pad_id = -1
    t.unk_piece = "unk"
    n = model.normalizer_spec
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes by one rank file and one pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self._encode = self.model.encode_as_ids if hasattr(self.model, "encode_as_ids") else self.model.encode
        self.unknown = self.model.unk_id()
        chars = byte_chars()
        self.table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [bytes([back[c] for c in self.model.id_to_piece(i) if c in back]) for i in range(self.unknown)]
        # `units` holds for patterns in which a space joins only what follows it
        self.by_units = " ?" in pattern and r"\s+(?!\S)" in pattern
        self._memo = Memo(self._unit)
        self._pieces = Memo(self._piece)

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        if rank is not None:
            return [rank]
        ids = self._encode(raw.decode("latin-1").translate(self.table))
        if self.unknown in ids:
            raise ValueError("the vocabulary lacks a byte")
        return ids

    def _unit(self, unit: str) -> tuple[str, int, bytes]:
        pieces = self.pattern.findall(unit)
        ids = self._pieces[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in self._pieces[p]]
        return ",".join(map(str, ids)), len(ids), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self._piece(piece)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids, sha256 of the bytes decoded from them."""
        cut = units(text) if self.by_units else None
        memo = self._memo
        parts = [memo[u] for u in (self.pattern.findall(text) if cut is None else cut)]
        ids = ",".join([p[0] for p in parts if p[1]])
        return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()


@lru_cache(4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row's whole text."""
    types = {id_col: None, "ids": pa.list_(pa.int32()), "decoded": pa.binary()}

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, types["ids"]), pa.array([c.decode(i) for i in ids], types["decoded"])], names=list(types))

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def digest_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, without moving the ids."""
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        c = codec(ranks_path, pattern)
        gc.disable()  # the memos hold no cycles, and scanning them costs as much as the encoding
        try:
            for b in batches:
                rows = [c.digest(t or "") for t in b.column(1).to_pylist()]
                out = to_batch({k: [r[i] for r in rows] for i, k in enumerate(types)}, types)
                yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=[id_col, *types])
        finally:
            gc.enable()  # the worker may serve other queries next

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
