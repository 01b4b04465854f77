"""SentencePiece encoding and decoding with spans in the original text.

The normaliser is read from the model file: its compiled character map (a double-array trie with a
block of replacement strings), the dummy prefix, white-space removal and escaping. Text is
normalised here by longest-prefix matches in that trie, recording for every byte of the result the
original bytes it came from. The merges then run on the normalised text in a processor whose own
normaliser is switched off, and each piece is projected through the alignment to a byte span of
the original text.

Cases: null and empty texts have no pieces and decode to the empty text; repeated rows are encoded
alike; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import map_texts

SPACE = "▁".encode()
BYTE, USER_DEFINED = 6, 4


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """Fields of a protocol-buffer message: number, value, start and end in ``raw``."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            value |= (byte & 127) << shift
            shift, i = shift + 7, i + 1
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        start = i
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if tag & 7 == 1 else (4, i) if tag & 7 == 5 else varint(i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value, start, i


def _message(number: int, body: bytes) -> bytes:
    size, out = len(body), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out + bytes([size]) + body)


class CharacterMap:
    """Longest-prefix replacement by the compiled map of a model."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        #: Bytes that can start a match.
        self.starts = {b for b in range(256) if self._step(self._root(), b) is not None} if self.units else set()

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 0xFF) == byte else None

    def match(self, raw: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``i`` and its replacement."""
        node, found = self._root(), None
        for j in range(i, len(raw)):
            at = self._step(node, raw[j])
            if at is None:
                break
            unit = self.units[at]
            node = at ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & ((1 << 31) - 1)
                found = j + 1 - i, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        spec: dict[int, int | bytes] = {}
        pieces, types, kept = [], [], bytearray()
        for number, value, start, end in _fields(raw):
            if number == 1:
                piece = {n: v for n, v, _, _ in _fields(value)}
                pieces.append(piece.get(1, b""))
                types.append(piece.get(3, 1))
            if number == 3:
                spec = {n: v for n, v, _, _ in _fields(value)}
            else:
                kept += raw[start:end]
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.remove_extra, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if USER_DEFINED in types:
            raise ValueError("models with user-defined symbols are not supported")
        #: Bytes of normalised text that a piece covers; 0: the unknown piece covers one character or more.
        self.sizes = np.array([1 if t == BYTE else len(p) for p, t in zip(pieces, types, strict=True)], np.int64)
        self.unknown = [i for i, t in enumerate(types) if t == 2]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # the same pieces with a normaliser that changes nothing: name, no dummy prefix, no removal, no escaping
        plain = _message(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.core = sentencepiece.SentencePieceProcessor(model_proto=bytes(kept) + _message(3, plain))

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text in UTF-8, and for each of its bytes, and its end, the original offset."""
        raw = text.encode()
        blank = SPACE if self.escape else b" "
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.map.starts and not self.remove_extra:
            # nothing but blanks changes: one array operation instead of a walk
            body = raw.replace(b" ", blank)
            widths = np.ones(len(raw), np.int64)
            if self.escape:
                widths[np.frombuffer(raw, np.uint8) == 32] = len(blank)
            at = np.repeat(np.arange(len(raw)), widths)
            head = blank if self.dummy_prefix else b""
            return head + body, np.concatenate([np.zeros(len(head), np.int64), at, [len(raw)]])
        out, at, i = bytearray(), [], 0
        units: list[tuple[bytes, int]] = []
        while i < len(raw):
            found = self.map.match(raw, i) if raw[i] in self.map.starts else None
            first = raw[i]
            n, new = found or ((n := 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)), raw[i : i + n])
            units.append((new, i))
            i += n
        start = 0
        if self.remove_extra:
            while start < len(units) and units[start][0] == b" ":
                start += 1
            if start == len(units):
                return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += blank
            at += [units[start][1]] * len(blank)
        gap = self.remove_extra
        for new, origin in units[start:]:
            if self.remove_extra:
                while gap and new.startswith(b" "):
                    new = new[1:]
                if new:
                    gap = new.endswith(b" ")
            new = new.replace(b" ", blank) if self.escape else new
            out += new
            at += [origin] * len(new)
        end = len(raw)
        if self.remove_extra:
            while out.endswith(blank):
                end = at[len(out) - len(blank)]
                del out[-len(blank) :], at[-len(blank) :]
        return bytes(out), np.array([*at, end], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the original byte offsets where each piece starts and ends."""
        (row,) = self.encode_all([text])
        return row

    def encode_all(self, texts: list[str | None]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        normal = [self.normalise(t or "") for t in texts]
        out = []
        for (body, at), ids in zip(normal, self.core.encode([b.decode() for b, _ in normal], num_threads=1), strict=True):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if self.unknown and np.isin(ids, self.unknown).any():
                sizes = np.array([len(p.encode()) for p in self.core.encode(body.decode(), out_type=str)], np.int64)
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1] != len(body):
                raise ValueError("pieces do not cover the normalised text")
            out.append((ids, at[ends - sizes], at[ends]))
        return out

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


FIELDS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "begins": T.ArrayType(T.IntegerType(), False),
    "ends": T.ArrayType(T.IntegerType(), False),
    "decoded": T.StringType(),
}


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row for each document: ``keep``, the ids of the whole text, the original UTF-8 byte span
    of each piece (``begins``, ``ends``) and the text decoded from the ids. A narrow map without a
    shuffle; ``path`` is the model file on every executor."""

    def make():
        codec = Codec(path)

        def ragged(parts, dtype, kind):
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate([np.asarray(p, dtype) for p in parts]) if parts else np.zeros(0, dtype)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))

        def work(texts):
            rows = codec.encode_all(texts)
            ids = [r[0] for r in rows]
            return (
                ragged(ids, np.int32, pa.int32()).cast(pa.list_(pa.field("element", pa.int32(), False))),
                ragged([r[1] for r in rows], np.int32, pa.int32()).cast(pa.list_(pa.field("element", pa.int32(), False))),
                ragged([r[2] for r in rows], np.int32, pa.int32()).cast(pa.list_(pa.field("element", pa.int32(), False))),
                codec.decode_all(ids),
            )

        return work

    return map_texts(docs, keep, text, list(FIELDS.items()), make, limit=2 << 20)


def decode_ids(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Texts of stored ids: ``keep`` and ``decoded``; null ids give null."""
    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            rows = batch.column(len(keep)).to_pylist()
            texts = iter(codec.decode_all([r for r in rows if r is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([None if r is None else next(texts) for r in rows], pa.string())], names=schema.names)

    return encoded.select(*keep, ids).mapInArrow(run, schema)
