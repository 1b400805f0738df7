"""Token encoders that run inside tasks.

Tokenizer libraries are slow per call and fast per distinct word, and words repeat.
``ChunkEncoder`` therefore cuts texts where no token can span the cut, looks all units
up at once in a numpy hash table and asks the library, in one call per step, for those
it doesn't hold. A text with white space that makes a cut unsafe goes to the library
whole, so the ids are those of the library in every case.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

from .packed import SHORT_BYTES, joined, packed, radix_order, run_starts, unpacked

#: Bytes that the tables of a worker's encoder may take.
STORE_BYTES = 64 << 20
#: Words in one text that the library gets.
CALL_WORDS = 4096

# classes of bytes; a unit is a run of letters, a run of marks, or a chunk with any other byte
END, SPACE, LINE, LETTER, MARK, OTHER = range(6)
MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^`{|}~<"
LEAD = 0xC3


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


@functools.lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process; another file takes the place of the last."""
    return ChunkEncoder(path)


class Store:
    """Ids of units of up to 16 bytes, by their packed words: an open hash table of row
    numbers, and the ids of all rows end to end. Rows are looked up and added many at a time."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.rows = 0
        self.words = [np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)]
        self.starts = np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, self.kind)
        self.table = np.zeros(4096, np.int32)
        self.others: dict[bytes, int] = {}
        self.other_bytes = 0

    @property
    def bytes(self) -> int:
        return sum(a.nbytes for a in (*self.words, self.starts, self.ids, self.table)) + self.other_bytes

    def _slots(self, words: list[np.ndarray]) -> np.ndarray:
        h = (words[0] ^ words[1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(32)).astype(np.int64) & len(self.table) - 1

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """Row of each unit, -1 for one not held."""
        out = np.full(len(words[0]), -1, np.int64)
        slot, at = self._slots(words), None
        while len(slot):
            row = self.table[slot].astype(np.int64) - 1
            mine = words if at is None else [w[at] for w in words]
            same = (row >= 0) & (self.words[0][row] == mine[0]) & (self.words[1][row] == mine[1])
            on = (row >= 0) & ~same
            if at is None:
                out[same] = row[same]
                at = np.flatnonzero(on)
            else:
                out[at[same]] = row[same]
                at = at[on]
            slot = slot[on] + 1 & len(self.table) - 1
        return out

    def _place(self, rows: np.ndarray) -> None:
        slot = self._slots([w[rows] for w in self.words])
        while len(rows):
            free = self.table[slot] == 0
            self.table[slot[free]] = rows[free] + 1  # the last of several stays
            on = self.table[slot] != rows + 1
            rows, slot = rows[on], slot[on] + 1 & len(self.table) - 1

    def add(self, words: list[np.ndarray] | None, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New rows with these ids end to end; without words they are found by ``others`` alone."""
        first, self.rows = self.rows, self.rows + len(sizes)
        while len(self.words[0]) < self.rows:
            self.words = [np.concatenate([w, np.zeros_like(w)]) for w in self.words]
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) - 1, np.int64)])
        at = int(self.starts[first])
        self.starts[first + 1 : self.rows + 1] = at + np.cumsum(sizes)
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        new = np.arange(first, self.rows)
        if words is not None:
            for mine, given in zip(self.words, words, strict=True):
                mine[first : self.rows] = given
            if len(self.table) < 2 * self.rows:
                self.table = np.zeros(len(self.table) * 2 ** int(np.ceil(np.log2(2 * self.rows / len(self.table)) + 1e-9)), np.int32)
                held = np.arange(self.rows)
                self._place(held[self.words[0][: self.rows] != 0])
            else:
                self._place(new)
        return new

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows end to end, and how many each row has."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


class ChunkEncoder:
    """Ids of texts under a ``tokenizers`` file.

    Where a cut is safe follows from the file's pre-tokenizer:

    * byte level with its own pattern: before a line end or a single space that
      stands between two characters that aren't white space. The space belongs to
      the unit behind it, the line end is a unit of its own.
    * split on white space that is removed: at every space and line end.
    * anything else: nowhere.

    Both also cut between letters that every Unicode version knows (ASCII and U+00C0 to
    U+00FF) and ASCII marks without apostrophe, underscore and those of added tokens, so
    a chunk of letters and marks is a row of units; any other chunk is one unit.
    Tables that outgrow ``limit`` bytes start anew before the next step.
    """

    def __init__(self, path: str, limit: int = STORE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = id_type(self.library.get_vocab_size(with_added_tokens=True))
        self.limit = limit
        spec = json.loads(self.library.to_str())
        self.kind = self._kind(spec)
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.classes = np.full(256, OTHER, np.uint8)
        self.classes[[*range(65, 91), *range(97, 123), LEAD]] = LETTER
        self.classes[list(MARKS)] = MARK
        self.classes[[ord(" "), ord("\n")]] = SPACE, LINE
        for t in spec.get("added_tokens", []):
            self.classes[t["content"].encode()[0]] = OTHER
        self.fold = np.arange(256, dtype=np.uint8)
        if self.lowers:
            self.fold[65:91] += 32
        self.store = Store(self.type)
        if self.kind != "whole":
            self.between = "\n" if self.kind == "spaced" else " 0 "
            mark = self._library([self.between])[0]
            self.mark = int(mark[0]) if len(mark) == 1 else None

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        if any(t["content"] != t["content"].strip() or " " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            return "whole"
        if len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and norm is None:
            return "spaced"
        first = parts[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" not in first["pattern"].get("Regex", "\\s").replace("[^\\s", ""):
            return "dropped"
        return "whole"

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of letters or marks end to end, and their numbers. The library gets
        many in one text, with a unit between them that none of them can give or touch."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.type)]
        for lo in range(0, len(units), CALL_WORDS):
            part = units[lo : lo + CALL_WORDS]
            found = self._library([self.between.join(part)])[0] if self.mark is not None else None
            ends = np.flatnonzero(found == self.mark) if found is not None else np.zeros(0)
            if found is None or len(ends) != len(part) - 1:
                each = self._library(part)
                sizes.append(np.array([len(x) for x in each], np.int64))
                ids += each
                continue
            sizes.append(np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1)
            ids.append(found[found != self.mark])
        return np.concatenate(sizes), np.concatenate(ids)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each; a NULL text has none."""
        if self.kind == "whole":
            found = self._library([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, self.type), *found]), np.array([len(f) for f in found], np.int64)
        if self.store.bytes > self.limit:
            self.store.clear()
        data, begins = joined(texts)
        classes = self._classes(data, begins)
        whole = self._unsafe(classes, begins) if self.kind == "spaced" else np.zeros(len(begins), bool)
        starts, ends, kinds = self._cut(classes)
        doc = np.searchsorted(begins, starts, "right") - 1
        row = self._rows(data, starts, ends, kinds, doc, whole)
        keep = ~whole[doc]
        ids, each = self.store.gather(row[keep])
        sizes = np.bincount(doc[keep], weights=each, minlength=len(begins)).astype(np.int64)
        if whole.any():
            at, parts = np.cumsum(sizes) - sizes, []
            last = 0
            for d in np.flatnonzero(whole).tolist():
                own = self._library([texts[d].as_py()])[0]
                parts += [ids[last : at[d]], own]
                last, sizes[d] = at[d], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``type``."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def _classes(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The class of each byte, every byte of a chunk with an OTHER byte being OTHER."""
        classes = self.classes[data]
        lead = np.flatnonzero(data == LEAD)
        second = data[lead + 1]
        classes[lead + 1] = LETTER
        sign = (second == 0x97) | (second == 0xB7)  # multiplication and division
        classes[lead[sign]] = classes[lead[sign] + 1] = OTHER
        classes[0] = END
        classes[begins - 1] = END
        classes[len(data) - SHORT_BYTES - 1 :] = END
        odd = np.flatnonzero(classes == OTHER)
        if len(odd):
            edge = np.flatnonzero((classes[1:] >= LETTER) != (classes[:-1] >= LETTER)) + 1
            chunk = np.unique(np.searchsorted(edge, odd, "right") - 1)
            first, last = edge[chunk], edge[chunk + 1]
            sizes = last - first
            classes[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = OTHER
        return classes

    @staticmethod
    def _unsafe(classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Texts with a blank or a line end beside another one or at an end of the text."""
        blank = classes < LETTER
        beside = np.flatnonzero(blank[1:] & blank[:-1] & ((classes[1:] != END) | (classes[:-1] != END)))
        out = np.zeros(len(begins) + 1, bool)
        # a pair that starts with the byte in front of a text belongs to that text
        out[np.searchsorted(begins - 1, beside, "right") - 1] = True
        return out[:-1]

    def _cut(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and classes of the units."""
        edge = np.empty(len(classes), bool)
        edge[0] = True
        np.not_equal(classes[1:], classes[:-1], out=edge[1:])
        edge |= classes == LINE
        at = np.flatnonzero(edge)
        kinds = classes[at]
        wanted = kinds >= (LINE if self.kind == "spaced" else LETTER)
        starts, ends, kinds = at[wanted], np.append(at[1:], len(classes))[wanted], kinds[wanted]
        if self.kind == "spaced":
            starts = starts - ((classes[starts - 1] == SPACE) & (kinds != LINE))
        return starts, ends, kinds

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Row of the store for each unit; marks texts with an unsafe unit in ``whole``."""
        lengths, row = ends - starts, np.full(len(starts), -1, np.int64)
        short = np.flatnonzero((lengths <= SHORT_BYTES) & (kinds != OTHER))
        folded = data
        if self.lowers:
            folded = self.fold[data]
            after = np.flatnonzero(data == LEAD) + 1
            folded[after] += 32 * (data[after] < 0x9F).astype(np.uint8)
        words = packed(folded, starts[short], lengths[short], SHORT_BYTES // 2)
        words[1][lengths[short] <= 8] = 0
        row[short] = self.store.find(words)
        new = np.flatnonzero(row[short] < 0)
        if len(new):
            keys = [w[new] for w in words]
            order = radix_order(keys)
            keys = [k[order] for k in keys]
            first = run_starts(keys)
            keys = [k[first] for k in keys]
            lines = unpacked(keys).tolist()
            if self.kind == "spaced" and b"\n" in lines:
                at = lines.index(b"\n")
                sizes, ids = self._units([x.decode() for i, x in enumerate(lines) if i != at])
                place = int(sizes[:at].sum())
                sizes, ids = np.insert(sizes, at, 1), np.insert(ids, place, self.mark)
            else:
                sizes, ids = self._units([x.decode() for x in lines])
            rows = self.store.add(keys, sizes, ids)
            found = np.empty(len(new), np.int64)
            found[order] = np.repeat(rows, np.diff(np.append(first, len(order))))
            row[short[new]] = found
        rest = np.flatnonzero(row < 0)
        if len(rest):
            row[rest] = self._others(data, starts[rest], ends[rest], doc[rest], whole)
        return row

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Rows of long units and of chunks with other characters, one by one."""
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        held, store = self.store.others, self.store
        texts = {u: u.decode() for u in dict.fromkeys(units) if u not in held}
        if self.kind == "spaced":
            for u, d in zip(units, doc.tolist(), strict=True):
                if u not in held:
                    body = texts[u].removeprefix(" ")
                    whole[d] |= body[0].isspace() or body[-1].isspace()
            texts = {u: t for u, t in texts.items() if not (t.removeprefix(" ")[0].isspace() or t[-1].isspace())}
        ids = self._library(list(texts.values()))
        rows = store.add(None, np.array([len(x) for x in ids], np.int64), np.concatenate([np.zeros(0, self.type), *ids]))
        held.update(zip(texts, rows.tolist(), strict=True))
        store.other_bytes += sum(len(u) + 150 for u in texts)
        return np.array([held.get(u, -1) for u in units], np.int64)


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text with ``end_id`` behind them, and their numbers."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def widened(ids: bytes, kind: np.dtype) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, kind).astype("<u4").tobytes()


def safe_pieces(text: str, most: int) -> list[str]:
    """Cut a text into pieces of at most about ``most`` characters, each cut at a
    single space between two characters that aren't white space; the space is left
    out. A stretch without such a place stays in one piece."""
    pieces, start = [], 0
    while len(text) - start > most:
        at = text.rfind(" ", start + 1, start + most)
        while at > start and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            at = text.find(" ", start + most)
            while 0 < at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if not 0 < at < len(text) - 1:
                break
        pieces.append(text[start:at])
        start = at + 1
    pieces.append(text[start:])
    return pieces
