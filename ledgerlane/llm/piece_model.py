"""SentencePiece encoding that keeps source positions, and decoding.

``CharacterMap`` is the normaliser of a model file: at every place the longest
entry of the compiled character map that is a prefix of the rest is replaced,
anything else stays, and for every byte that comes out the place it came from
is recorded.  Pieces are then laid along the normalised text, so the record
projects each of them to a span of bytes of the source text.

Encoding itself is the library's.  Where a model's map is empty, the record is
known without making it: every space mark stands for one byte of the source.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import sentencepiece

MARK = "▁"


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The normaliser written in a model (a serialized ``ModelProto``)."""

    def __init__(self, model: bytes):
        spec = dict(wire_fields(next((value for field, value in wire_fields(model) if field == 3), b"")))
        compiled = spec.get(2, b"")
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.units, self.texts = (), b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist()
            self.texts = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry at a place, and its replacement.

        The map is a double-array trie: a unit holds a label, the offset to
        its children, and whether one of them holds a value.
        """
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= _offset(unit)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start:self.texts.index(b"\0", start)]

    def steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source start, source end, and what stands for it."""
        at = 0
        while at < len(data):
            entry = self.longest(data, at)
            if entry:
                size, out = entry
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at:at + size]
            yield at, at + size, out
            at += size

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised text, and for every byte of it (and its end) the place
        in the source bytes that it came from."""
        data = text.encode()
        space = MARK.encode() if self.escape else b" "
        out, places = bytearray(), []
        parts = list(self.steps(data))
        if self.trim:
            while parts and not parts[0][2].strip(b" "):
                parts.pop(0)
        end = parts[-1][1] if parts else 0
        if self.prefix and parts:
            out += space
            places += [parts[0][0]] * len(space)
        blank = self.trim
        for start, stop, piece in parts:
            same = piece == data[start:stop]
            if self.trim and blank:
                piece = piece.lstrip(b" ")
            for k, byte in enumerate(piece):
                char = space if byte == 32 else bytes([byte])
                out += char
                places += [start + k if same and byte != 32 else start] * len(char)
            if piece:
                blank = piece.endswith(b" ")
        if self.trim:
            while out.endswith(space):
                del out[-len(space):]
                end = places[len(out)]
                del places[len(out):]
        return bytes(out), [*places, end]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A model file with its library processor, as a worker holds it."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = self.processor.eos_id()
        self.map = CharacterMap(self.processor.serialized_model_proto())
        size = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(size)]
        byte = [self.processor.is_byte(i) for i in range(size)]
        # Nothing is replaced but spaces, and no piece stands for unknown text.
        self.plain = not self.map.units and self.map.prefix and self.map.escape and not self.map.trim and any(byte)
        # Source bytes of a piece: a space mark stands for one byte.
        self.lengths = np.array([1 if b else len(p.encode()) - 2 * p.count(MARK) for p, b in zip(pieces, byte)])
        self.is_byte = byte
        self.decimals = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text, with the end id."""
        return self.processor.encode(texts, add_eos=True, num_threads=1) if texts else []

    def as_decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))

    def ends(self, text: str, ids: list[int]) -> np.ndarray:
        """Where each piece ends in the bytes of the source text; it begins
        where the one before it ends.  The end id is empty."""
        if self.plain and MARK not in text:
            sizes = self.lengths[ids]
            sizes[-1] = 0
            if text:
                sizes[0] -= 1  # the mark in front of the text stands for nothing
            return np.cumsum(sizes)
        normalised, places = self.map.normalise(text)
        proto = self.processor.encode(text, return_type="proto")
        at, out = 0, []
        for piece in proto.pieces:
            at += 1 if self.is_byte[piece.id] else len(piece.piece.encode())
            out.append(places[min(at, len(normalised))])
        return np.array([*out, out[-1] if out else 0], dtype=np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids) if ids else []


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)
