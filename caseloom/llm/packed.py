"""Terms of many texts as packed words, sorted by radix and counted in numpy.

A term is a run of non-zero codes in a byte buffer. Terms go into buckets by length:
up to 16 bytes they are one or two big-endian 64-bit words, padded with zeros, and
sorted by 16-bit digits, no more of them than the bucket's length asks for; longer
ones have a bucket per length and are sorted as bytes. Equal terms always share a
bucket, and codes are never zero, so padding tells no two terms apart wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BYTES = 8
SHORT_BYTES = 2 * WORD_BYTES
DIGIT_BYTES = 2

#: Zeros behind the last text, so that two words can be read at every start.
_TAIL = bytes(SHORT_BYTES)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts with a zero byte before and behind each, and the place
    of the first byte of each text. A NULL text is an empty one."""
    flat = pc.fill_null(texts.cast(pa.binary()), b"")
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = 1 + np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), b"\0")[0].as_py() if len(flat) else b""
    return np.frombuffer(b"\0" + body + b"\0" + _TAIL, np.uint8), starts


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of non-zero codes; the first and the last code are zero."""
    inside = codes != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2] - edges[::2]


def bucket_of(lengths: np.ndarray) -> np.ndarray:
    """Digits of a short term, the length of a long one."""
    return np.where(lengths <= SHORT_BYTES, (lengths + DIGIT_BYTES - 1) // DIGIT_BYTES, lengths)


def is_short(bucket: int) -> bool:
    return bucket <= SHORT_BYTES // DIGIT_BYTES


def packed(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bucket: int) -> list[np.ndarray]:
    """The keys of terms of one bucket: one or two words, or byte strings."""
    if not is_short(bucket):
        rows = np.lib.stride_tricks.sliding_window_view(codes, bucket)[starts]
        return [np.ascontiguousarray(rows).view(f"S{bucket}").ravel()]
    view = np.ndarray(len(codes) - WORD_BYTES + 1, ">u8", codes, strides=(1,))
    words = []
    for at in range(0, bucket * DIGIT_BYTES, WORD_BYTES):
        spare = (8 * np.clip(at + WORD_BYTES - lengths, 0, WORD_BYTES - 1)).astype(np.uint64)
        words.append(view[starts + at].astype(np.uint64) >> spare << spare)
    return words


def unpacked(keys: list[np.ndarray]) -> np.ndarray:
    """Terms as byte strings."""
    if keys[0].dtype.kind == "S":
        return keys[0]
    return np.stack(keys, axis=1).astype(">u8", order="C").view(f"S{WORD_BYTES * len(keys)}").ravel()


def radix_order(keys: list[np.ndarray], minor: np.ndarray | None = None) -> np.ndarray:
    """A stable order by keys, most significant first, and then by ``minor``, a
    non-negative integer. Words are sorted digit by digit from the last, where
    numpy's stable sort of 16-bit numbers is a radix sort; a digit that all share
    is passed over. Byte strings are compared whole."""
    order = None
    columns = list(keys) if minor is None else [*keys, minor]
    for key in reversed(columns):
        if key.dtype.kind == "S":
            step = np.argsort(key if order is None else key[order], kind="stable")
            order = step if order is None else order[step]
            continue
        word = key.astype(np.uint64)
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if not len(digit) or (digit[0] == digit).all():
                continue
            if order is not None:
                digit = digit[order]
            step = np.argsort(digit, kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Places where a row differs from the one before it in any column."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Bag:
    """Counts of (term, group), kept by bucket. ``sums`` is a list of integer
    columns that add up over equal (term, group)."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]]] = {}
        self.rows = 0

    def add(self, bucket: int, keys: list[np.ndarray], group: np.ndarray, sums: list[np.ndarray]) -> None:
        self.parts.setdefault(bucket, []).append((keys, group, sums))
        self.rows += len(group)

    def compact(self) -> None:
        """Bring equal (term, group) together; every bucket is sorted by both."""
        self.rows = 0
        for bucket, parts in self.parts.items():
            keys = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
            group = np.concatenate([p[1] for p in parts])
            sums = [np.concatenate(c) for c in zip(*(p[2] for p in parts), strict=True)]
            if len(parts) > 1:
                order = radix_order(keys, group)
                keys, group = [k[order] for k in keys], group[order]
                first = run_starts([*keys, group])
                sums = [np.add.reduceat(s[order], first) for s in sums]
                keys, group = [k[first] for k in keys], group[first]
            self.parts[bucket] = [(keys, group, sums)]
            self.rows += len(group)

    def items(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray]]]:
        """(bucket, keys, group, sums) of each bucket of a compact bag."""
        for bucket, parts in sorted(self.parts.items()):
            yield bucket, *parts[0]

    def clear(self) -> None:
        self.parts.clear()
        self.rows = 0


def count_runs(bag: Bag, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, doc: np.ndarray) -> None:
    """Add the terms at these places: occurrences, and documents that hold them.
    Terms come in order of (group, doc), and a doc lies in one group."""
    buckets = bucket_of(lengths)
    for bucket in np.unique(buckets).tolist():
        at = np.flatnonzero(buckets == bucket)
        keys = packed(codes, starts[at], lengths[at], bucket)
        order = radix_order(keys)  # stable: the order of groups and documents stays
        at, keys = at[order], [k[order] for k in keys]
        first = run_starts([*keys, group[at]])
        n = np.diff(np.append(first, len(at)))
        new = np.zeros(len(at), np.int64)
        new[first] = 1
        new[1:] |= doc[at][1:] != doc[at][:-1]
        bag.add(bucket, [k[first] for k in keys], group[at[first]], [n, np.add.reduceat(new, first)])


def blocks_of(keys: list[np.ndarray], blocks: int) -> np.ndarray:
    """A block number below ``blocks`` for each term, by a hash of its bytes."""
    if keys[0].dtype.kind == "S":
        width = keys[0].dtype.itemsize
        cells = np.ascontiguousarray(keys[0]).view(np.uint8).reshape(-1, width)
        mixed = np.full(len(keys[0]), width, np.uint64)
        for column in range(width):
            mixed = (mixed ^ cells[:, column]) * np.uint64(0x100000001B3)
    else:
        mixed = np.zeros(len(keys[0]), np.uint64)
        for key in keys:
            mixed = (mixed ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
