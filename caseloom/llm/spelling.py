"""Spelling variant grouping (operator 12): frequent words one edit apart, found by
products of letter-count matrices.

An edit changes the counts of a word's letters by a squared distance of at most two:
two for a replaced letter, one for an inserted or deleted one. Distances of a block of
words to another are one matrix product. Which blocks must meet follows from the same
thought on a coarser scale: letters fall into a few classes, a block is the words with
the same count in each class, and an edit moves one letter from class to class, or adds
one. So a block meets itself, the blocks of its length with one letter in another class,
and the blocks one letter longer. Large blocks are split into equal chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import inputs
from .packed import Bag, bucket_of, joined, packed, radix_order, run_starts, runs, unpacked

#: Bytes of text that are sorted at once.
STEP_BYTES = 8 << 20
#: Words of a task that are held before they are handed on.
HELD_ROWS = 1_000_000
#: Cells of one distance matrix, and of one table of letters compared.
CELLS = 1 << 21
#: Runs up to this length get their checksums side by side.
SIDE_BY_SIDE = 64

LEAD = 0xC3  # first UTF-8 byte of the letters from U+00C0 to U+00FF, and of no other
#: A lower-cased ASCII letter as it is, zero for the rest.
ASCII = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 0 for b in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32, polynomial 0xEDB88320."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


@dataclass(frozen=True)
class Settings:
    """``classes`` of letters; None takes more for a larger vocabulary, so that
    blocks stay small. ``chunk`` is the number of words in a chunk of a block."""

    least_length: int = 5
    least_count: int = 3
    typo_every: int = 97
    ratio: int = 2
    classes: int | None = None
    chunk: int = 1024


def letters(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One code per code point, zero where it isn't a letter, and the places of the texts in them."""
    lead = data == LEAD
    codes = ASCII[data]
    after = np.flatnonzero(lead[:-1]) + 1
    codes[after] = data[after] + 0x40
    return codes[~lead], begins - np.searchsorted(after, begins, "right")


def checksums(prefix: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of a prefix, given by its CRC-32, followed by each run in UTF-8."""
    state = ~prefix.astype(np.uint32)
    step = lambda crc, byte: _CRC[(crc ^ byte) & 0xFF] ^ crc >> np.uint32(8)
    at = np.flatnonzero(lengths <= SIDE_BY_SIDE)
    for place in range(int(lengths[at].max(initial=0))):
        at = at[lengths[at] > place]
        letter = codes[starts[at] + place].astype(np.uint32)
        crc = state[at]
        wide = np.flatnonzero(letter >= 0xC0)
        crc[wide] = step(crc[wide], np.uint32(LEAD))
        letter[wide] -= 0x40
        state[at] = step(crc, letter)
    out = ~state
    for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
        run = codes[starts[i] : starts[i] + lengths[i]].tobytes().decode("latin-1")
        out[i] = zlib.crc32(run.encode(), int(prefix[i]))
    return out


def mistyped(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sums: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Delete code point sum % length of each run whose sum ``every`` divides."""
    hit = sums % every == 0
    places = starts[hit] + sums[hit].astype(np.int64) % lengths[hit]
    return np.delete(codes, places), starts - np.searchsorted(places, starts), lengths - hit


def word_counts(docs: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all words with at least ``least_length`` code points and ``least_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        bag = Bag()

        def hand_on() -> Iterator[pa.RecordBatch]:
            for _, keys, _, (n,) in bag.items():
                yield inputs.record(schema, [[w.decode("latin-1") for w in unpacked(keys).tolist()], n])
            bag.clear()

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = run_starts([np.cumsum(sizes) // STEP_BYTES]).tolist()
            for first, last in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
                rows = batch.slice(first, last - first)
                codes, begins = letters(*joined(rows.column(1)))
                starts, lengths = runs(codes)
                if not len(starts):
                    continue
                doc = np.searchsorted(begins, starts, "right") - 1
                prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in rows.column(0).to_pylist()], np.uint32)
                sums = checksums(prefix[doc], codes, starts, lengths)
                codes, starts, lengths = mistyped(codes, starts, lengths, sums, s.typo_every)
                long = lengths >= s.least_length
                starts, lengths = starts[long], lengths[long]
                buckets = bucket_of(lengths)
                for bucket in np.unique(buckets).tolist():
                    here = buckets == bucket
                    keys = packed(codes, starts[here], lengths[here], bucket)
                    order = radix_order(keys)
                    keys = [k[order] for k in keys]
                    edges = run_starts(keys)
                    bag.add(bucket, [k[edges] for k in keys], np.zeros(len(edges), np.int64), [np.diff(np.append(edges, len(order)))])
                if bag.rows > HELD_ROWS:
                    bag.compact()
                    if bag.rows > HELD_ROWS // 2:
                        yield from hand_on()
        bag.compact()
        yield from hand_on()

    counted = inputs.id_text(docs, doc_id, text).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of words as rows padded with zeros, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = max(1, int(lengths.max(initial=1)))
    cells = np.array([w.encode("latin-1") for w in words], f"S{width}")
    return cells.view(np.uint8).reshape(len(words), width), lengths


def letter_use(words: DataFrame) -> np.ndarray:
    """Occurrences of each of the 256 letter codes in the vocabulary, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(word.encode("latin-1"), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["letter", "n"])

    out = np.zeros(256, np.int64)
    for r in words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        out[r["letter"]] = r["n"]
    return out


def letter_classes(use: np.ndarray, classes: int) -> np.ndarray:
    """A class for each letter code: the most used letters first, each into the class
    least used so far."""
    out, load = np.zeros(256, np.int64), np.zeros(classes, np.int64)
    for letter in np.argsort(-use, kind="stable").tolist():
        out[letter] = int(load.argmin())
        load[out[letter]] += use[letter]
    return out


def class_count(words: int) -> int:
    """Two classes up to a few hundred words, one more for each tenfold."""
    return int(np.clip(np.round(np.log10(max(words, 1))), 2, 12))


def _moves(classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the class counts to the blocks that a block meets, and whether a
    change is to a longer word: each pair of blocks is met from one side alone."""
    unit = np.eye(classes, dtype=np.int64)
    moves = [np.zeros(classes, np.int64)]
    moves += [unit[j] - unit[i] for i in range(classes) for j in range(i + 1, classes)]
    moves += list(unit)
    return np.array(moves), np.array([m.sum() for m in moves])


def one_edit_same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in one place."""
    return (a != b).sum(1) == 1


def one_edit_longer(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of ``b`` that are rows of ``a``, of this length, with one code put in
    somewhere: an equal start and an equal end must cover all of ``a``."""
    place = np.arange(a.shape[1])
    inside = place < length[:, None]
    start = np.where(inside, a == b[:, :-1], False)
    end = np.where(inside, a == b[:, 1:], False)
    first = np.where(start, length[:, None], place).min(1)  # first place where the starts differ
    first = np.minimum(first, length)
    last = np.where(inside & ~end, place, -1).max(1)  # last place where the ends differ
    return first > last


class Chunk:
    """Words of one block with their counts and letter matrices."""

    def __init__(self, words: list[str], n: list[int]) -> None:
        self.words, self.n = words, np.array(n, np.int64)
        self.codes, self.lengths = _codes(words)

    def use(self, letters_used: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), 256), np.float64 if self.lengths.max(initial=0) > 2000 else np.float32)
        row, place = np.nonzero(self.codes)
        np.add.at(out, (row, self.codes[row, place]), 1)
        return out[:, letters_used]


def near_pairs(a: Chunk, b: Chunk, longer: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words of ``a`` and ``b`` one edit apart; ``longer``: those of
    ``b`` have one code point more; ``same``: both are one chunk, and i < j."""
    used = np.flatnonzero(np.bincount(a.codes.ravel(), minlength=256) + np.bincount(b.codes.ravel(), minlength=256))
    used = used[used > 0]
    left, right = a.use(used), b.use(used)
    # |x - y|^2 as one product: (x, |x|^2, 1) times (-2 y, 1, |y|^2)
    one = lambda m: np.ones((len(m), 1), m.dtype)
    right = np.concatenate([-2 * right, one(right), (right * right).sum(1, keepdims=True)], 1)
    left = np.concatenate([left, (left * left).sum(1, keepdims=True), one(left)], 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = max(a.codes.shape[1], b.codes.shape[1])
    for lo in range(0, len(left), max(1, CELLS // len(right))):
        part = left[lo : lo + max(1, CELLS // len(right))] @ right.T <= 2
        i, j = np.nonzero(part)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), max(1, CELLS // width)):
            x, y = i[at : at + max(1, CELLS // width)], j[at : at + max(1, CELLS // width)]
            if longer:
                shape = max(a.codes.shape[1], b.codes.shape[1] - 1)
                first = np.pad(a.codes, ((0, 0), (0, shape - a.codes.shape[1])))[x]
                second = np.pad(b.codes, ((0, 0), (0, shape + 1 - b.codes.shape[1])))[y]
                good = one_edit_longer(first, second, a.lengths[x])
            else:
                good = one_edit_same(a.codes[x], b.codes[y])
            found.append((x[good], y[good]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))


def _best(words: list[str], n: np.ndarray, other: list[str], other_n: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """For each word with near words: how many, and the one of largest n, ties to the least."""
    if not len(i):
        return
    rank = np.empty(len(other), np.int64)
    rank[sorted(range(len(other)), key=other.__getitem__)] = np.arange(len(other))
    order = np.lexsort((rank[j], -other_n[j], i))
    i, j = i[order], j[order]
    first = run_starts([i])
    for at, count in zip(first.tolist(), np.diff(np.append(first, len(i))).tolist(), strict=True):
        yield words[i[at]], count, int(other_n[j[at]]), other[j[at]]


def near_words(words: DataFrame, s: Settings) -> DataFrame:
    """word, n_near, best_n, best for each word of ``words`` (word, n) with a near word."""
    classes = s.classes or class_count(words.count())
    class_of = letter_classes(letter_use(words), classes)
    moves, added = _moves(classes)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            counts = [np.bincount(class_of[np.frombuffer(w.encode("latin-1"), np.uint8)], minlength=classes) for w in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))], names=["word", "n", "block"])

    keyed = written(words.select("word", "n").mapInArrow(keys, "word string, n long, block array<int>"), "words-keyed")
    sizes = keyed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / s.chunk).cast("int").alias("chunks"))
    dealt = keyed.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    chunks = written(dealt.groupBy("block", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("words")), "words-chunks")

    # each chunk waits for others at its own block and calls at the blocks it may meet
    calls = [F.array(*[(F.col("block")[k] + int(m[k])).cast("int") for k in range(classes)]) for m in moves]
    calling = chunks.select(F.col("chunk").alias("a_chunk"), F.col("words").alias("a_words"), F.posexplode(F.array(*calls)).alias("move", "block"))
    met = calling.join(chunks.select("block", "chunk", "words"), "block").filter("move > 0 or a_chunk <= chunk")
    met = met.select("move", F.expr("move = 0 and a_chunk = chunk").alias("same"), "a_words", "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
        chunk = lambda column, r: Chunk(*(column[r].values.field(k).to_pylist() for k in (0, 1)))
        for batch in batches:
            for r in range(batch.num_rows):
                move, same = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                a, b = chunk(batch.column(2), r), chunk(batch.column(3), r)
                i, j = near_pairs(a, b, bool(added[move]), same)
                rows = [*_best(a.words, a.n, b.words, b.n, i, j), *_best(b.words, b.n, a.words, a.n, j, i)]
                if rows:
                    yield inputs.record(schema, zip(*rows, strict=True))

    found = met.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x"))
    return found.select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def roots(linked: DataFrame, most: int, ratio: int) -> DataFrame:
    """word, root: forms followed to the last, by doubling. Counts grow by ``ratio``
    at each form, so the longest chain, and with it the number of rounds, is known."""
    found = written(linked.select("word", F.col("form").alias("root")), "words-roots")
    steps = 1
    while ratio**steps <= most:
        then = found.select(F.col("word").alias("_at"), F.col("root").alias("_then"))
        found = written(found.join(then, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_then", "root").alias("root")), "words-roots")
        steps *= 2
    return found


def variants(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased,
    some of them with one code point deleted: the one that the CRC-32 of
    "<doc_id>:<run>" points at, where ``typo_every`` divides it. A word needs
    ``least_length`` code points and ``least_count`` occurrences. Near words are one
    inserted, deleted or replaced code point apart. ``form`` is the near word of
    largest n, the least in code-point order among equals, if that n is at least
    ``ratio`` times the word's; ``root`` the last form of the chain, the word itself
    without one.

    NULL and empty texts have no words. Repeated rows count each. A NULL doc_id is
    written as nothing in front of the colon. An empty table gives no rows. Columns
    other than the two named are not read.
    """
    s = settings or Settings()
    words = written(word_counts(docs, s, doc_id, text), "words")
    near = near_words(words, s)
    enough = F.col("best_n") >= s.ratio * F.col("n")
    linked = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")
    )
    linked = written(linked, "words-forms")
    most = linked.agg(F.max("form_n")).head()[0] or 0
    last = roots(linked.filter("form is not null"), most, s.ratio)
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
