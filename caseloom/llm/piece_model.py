"""SentencePiece model files: settings, character map and piece lengths.

The model file is a protocol buffer; the few fields needed here are read
directly, so no generated classes are necessary.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np

#: The mark that stands for a space in normalised text.
MARK = "▁"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, message[i : i + size]
        i += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys whose
    values are places in a block of zero-ended replacements.

    A unit of the trie holds, from the low end: 8 bits of label, bit 8 for "has a
    value", bit 9 for a wide offset, and the offset above; a unit with the top bit
    set is a value.
    """

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that starts at this byte."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(0, start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """What the offset projection needs of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            message = f.read()
        self.library = SentencePieceProcessor(model_file=path)
        pieces, normalizer, suffix = [], b"", False
        for number, value in fields(message):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                suffix = bool(dict(fields(value)).get(24, 0))
            elif number == 3:
                normalizer = value
        spec = dict(fields(normalizer))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix = bool(spec.get(3, 1)) and not suffix
        self.trims = bool(spec.get(4, 1))
        self.escapes = bool(spec.get(5, 1))
        self.suffix = suffix
        names = [p[1] for p in pieces]
        kinds = np.array([p.get(3, 1) for p in pieces])  # 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte
        mark = MARK.encode()
        self.sizes = np.array([len(n) for n in names])
        self.sizes[kinds == 6] = 1
        self.sizes[(kinds == 2) | (kinds == 3)] = 0
        self.marks = np.where((kinds == 1) | (kinds == 4), [n.count(mark) for n in names], 0)
        #: No piece reaches over the left edge of a run of marks, so a text may be cut there.
        self.splits = self.prefix and self.escapes and not self.trims and not self.map and not any(mark in n.lstrip(mark) for n in names)
        self.plain = not self.map and not self.trims and self.escapes and not suffix
        self.unknown = {int(i) for i in np.flatnonzero(kinds == 2)}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte
        it comes from.

        At every place the longest key of the character map is replaced; elsewhere
        one character is kept. Spaces at the edges and repeated spaces go if the
        model says so, and spaces become marks.
        """
        out, source, i, blank = bytearray(), [], 0, self.trims
        mark, end = MARK.encode(), len(text)
        if self.trims:
            while i < end:
                size, piece = self._next(text, i)
                if piece.strip(b" "):
                    break
                i += size
        if self.prefix and i < end:
            out += mark if self.escapes else b" "
            source += [i] * len(out)
            blank = self.trims
        while i < end:
            size, piece = self._next(text, i)
            if self.trims and blank:
                piece = piece.lstrip(b" ")
            if piece:
                blank = piece.endswith(b" ")
                piece = piece.replace(b" ", mark) if self.escapes else piece
                out += piece
                source += [i] * len(piece)
            i += size
        tail = mark if self.escapes else b" "
        while self.trims and out.endswith(tail):
            del out[-len(tail) :]
            end = source[-len(tail)]
            del source[-len(tail) :]
        return bytes(out), np.array([*source, end], np.int64)

    def _next(self, text: bytes, i: int) -> tuple[int, bytes]:
        if self.map and (hit := self.map.longest(text, i)):
            return hit
        lead = text[i]
        size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return size, text[i : i + size]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one byte of each piece in the UTF-8 of ``text``.

        Pieces tile the normalised text, so their ends are running sums of lengths,
        projected to the source through the alignment. Where the map is empty that
        projection is arithmetic: a mark of three bytes stands for one byte, and the
        mark set in front stands for none.
        """
        raw = text.encode()
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.unknown.isdisjoint(ids.tolist() if len(ids) < 64 else np.unique(ids).tolist()):
            if self.plain:
                size = self.sizes[ids] - 2 * self.marks[ids]
                size[0] -= self.prefix
                ends = np.cumsum(size)
                if ends[-1] == len(raw):
                    return ends - size, ends
            normal, source = self.normalise(raw)
            ends = np.cumsum(self.sizes[ids])
            if ends[-1] == len(normal):
                return source[ends - self.sizes[ids]], source[ends]
        pieces = self.library.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces]), np.array([p.end for p in pieces])


@functools.lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)
