"""Near-duplicate documents by DartMinHash (operator 5).

Each document is a weighted set of word shingles. Every shingle owns a region whose
width is its weight; hashed darts fall on it as a Poisson process along a rank axis,
each dart with a coordinate. A document keeps the earliest dart of each coordinate, so
two documents agree on a coordinate with the probability of their weighted Jaccard
similarity. Only darts below a rank that covers all coordinates are thrown, about
k (ln k + 2) for k coordinates, whatever the number of shingles.

Coordinates are joined in bands. In a bucket all texts are compared with one of them;
texts that this leaves in other classes are compared with those others of the bucket that
can be near enough at all (``rest_of_groups``). Every link counted is checked on the
whole shingle sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import inputs

SLAB = 1 << 20
#: Pairs for each text of the groups from which on further representatives are tried.
ROUNDS_FROM = 4
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Settings:
    """``weights``: "set" gives each distinct shingle the weight 1, "count" its number
    of occurrences. At similarity 0.8 a pair shares a band of the default 32 x 6
    coordinates with probability 1 - (1 - 0.8^6)^32, above 0.9999."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    weights: str = "set"


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for the places of a slab."""
    def run(base: int) -> np.ndarray:
        out = np.full(SLAB + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_P), run(pow(_P, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, a run of bytes other than ASCII white space.

    The hash is a polynomial of the word's bytes, read off running sums, so a text
    costs a few passes over its bytes. Texts are worked on in slabs that end between
    words; a longer word is hashed alone.
    """
    raw = text.encode("utf-8", "surrogatepass")
    up, down = _powers()
    out, at = [], 0
    while at < len(raw):
        data = np.frombuffer(raw, np.uint8, count=min(SLAB, len(raw) - at), offset=at)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        if at + len(data) < len(raw):
            last = np.flatnonzero(blank)
            if not len(last):
                end = next((i for i in range(at + SLAB, len(raw)) if raw[i] in b" \t\n\x0b\x0c\r"), len(raw))
                out.append(np.frombuffer(hashlib.blake2b(raw[at:end], digest_size=8).digest(), np.uint64))
                at = end
                continue
            data, blank = data[: last[-1] + 1], blank[: last[-1] + 1]
        edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        at += len(data)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs. A text with fewer
    words than a shingle is one shingle; one without words has none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(_Q) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates of one weighted set."""
    return signatures(elements, weights, np.zeros(len(elements), np.int64), 1, k)[0]


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """[set, coordinate]: the earliest dart of each of ``k`` coordinates of the sets that
    ``owner`` deals the elements to; every set has an element.

    A weight is cut into strips of width 1; a dart on the last strip counts if it
    falls inside the weight. The darts of a strip come one after another with
    exponential gaps, all from hashes of (element, strip, number), so any two
    documents see the same darts. Sets with an empty coordinate get twice the rank.
    """
    limit = k * (np.log(k) + 2) / np.bincount(owner, weights, sets)
    first, wanted = np.zeros((sets, k), np.uint64), np.ones(sets, bool)
    while wanted.any():
        mine = wanted[owner]
        first[wanted], full = _thrown(elements[mine], weights[mine], (np.cumsum(wanted) - 1)[owner[mine]], limit[wanted], k)
        wanted[np.flatnonzero(wanted)[full]] = False
        limit *= 2
    return first


def _thrown(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest darts below each set's limit, and whether all coordinates of a set have one."""
    strips = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), strips)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    live, room, mine = elements[of] + nth.astype(np.uint64) * np.uint64(_P), weights[of] - nth, owner[of]
    live, rank, number = mix(live), np.zeros(len(of)), 0
    ranks, darts, cells = [], [], []
    while len(live):
        number += 1
        dart = mix(live + np.uint64(number * _Q & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(((dart >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40)
        keep = np.flatnonzero(rank < limit[mine])
        live, rank, dart, room, mine = live[keep], rank[keep], dart[keep], room[keep], mine[keep]
        inside = room >= 1
        if not inside.all():
            inside |= mix(dart).astype(np.float64) * 2.0**-64 < room
        ranks.append(rank[inside])
        darts.append(dart[inside])
        cells.append(mine[inside] * k + ((dart[inside] & np.uint64(0xFFFFFF)) % np.uint64(k)).astype(np.int64))
    rank, dart, cell = np.concatenate(ranks), np.concatenate(darts), np.concatenate(cells)
    best = np.full(len(limit) * k, np.inf)
    np.minimum.at(best, cell, rank)
    won = rank == best[cell]
    first = np.zeros(len(limit) * k, np.uint64)
    first[cell[won]] = dart[won]
    return first.reshape(-1, k), np.isfinite(best).reshape(-1, k).all(1)


def bands(signs: np.ndarray, n: int) -> np.ndarray:
    """One number per band of the signature, different from band to band."""
    rows = signs.reshape(n, -1)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * np.uint64(_Q) + rows[:, k])
    return h.view(np.int64)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, row_id (doc_id, or a hash of the text where that is NULL), text_key."""
    rows = inputs.id_text(docs, doc_id, text)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "text", F.coalesce("doc_id", key).alias("row_id"), key.alias("text_key"))


SIGNS = "doc_id long, row_id long, text_key long, node binary, n1 long, bands array<long>"


def signed(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row: 128 bits that name its word sequence, 64 of them as a number, bands."""

    @inputs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("n1", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                nodes, found = [], []
                for t in texts:
                    words = word_hashes(t)
                    nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                    found.append(shingles(words, s.words))
                full = [i for i, (elements, _) in enumerate(found) if len(elements)]
                signs: list = [[] for _ in texts]
                if full:
                    elements, counts = (np.concatenate([found[i][c] for i in full]) for c in (0, 1))
                    weights = counts.astype(np.float64) if s.weights == "count" else np.ones(len(elements))
                    owner = np.repeat(np.arange(len(full)), [len(found[i][0]) for i in full])
                    each = signatures(elements, weights, owner, len(full), s.bands * s.rows)
                    for i, row in zip(full, each, strict=True):
                        signs[i] = bands(row, s.bands)
                yield inputs.record(schema, [*(batch.column(i).slice(first, len(texts)) for i in (0, 2, 3)), nodes, [int.from_bytes(n[:8], "little", signed=True) for n in nodes], signs])

    return keyed(docs).mapInArrow(run, SIGNS)


def shingle_sets(rows: DataFrame, s: Settings) -> DataFrame:
    """n1, shingles (sorted; an occurrence is a further number under "count") of rows of n1, text."""

    @inputs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n1", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                sets = []
                for t in texts:
                    elements, counts = shingles(word_hashes(t), s.words)
                    if s.weights == "count":
                        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        elements = mix(np.repeat(elements, counts) + nth.astype(np.uint64) * np.uint64(_P))
                    sets.append(elements.view(np.int64))
                yield inputs.record(schema, [batch.column(0).slice(first, len(texts)), sets])

    return rows.select("n1", "text").mapInArrow(run, "n1 long, shingles array<long>")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (shingles in common), n_a, n_b of the distinct pairs (a, b), a written table.
    A text that stands for a large bucket is in many pairs, so its set goes to several tasks."""
    left = sets.select(F.col("n1").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("n1").alias("b"), F.col("shingles").alias("y"))
    rows = inputs.spread_join(pairs, right, "b", "a").join(left, "a")
    return rows.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), F.size("x").alias("n_a"), F.size("y").alias("n_b")).distinct()


def linked(rows: DataFrame, similarity: float) -> DataFrame:
    return rows.filter(F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def apart(group: DataFrame) -> DataFrame:
    """Groups (rep, n1, root, weight), a written table, with texts of more than one class, ``main`` being
    the class of most of them and ``apart`` marking the texts of others."""
    sizes = group.groupBy("rep", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("rep").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return inputs.spread_join(group.drop("main", "apart"), main.drop("classes"), "rep", "n1").withColumn("apart", F.col("root") != F.col("main"))


def more_representatives(group: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Groups, and links found, after further texts stood for large groups.

    In a group of edited copies the first representative misses some by a little. A
    round takes the next text of the main class and compares those that are apart
    with it; those near it, and the texts of their classes, are then of the main class.
    It is a matter of cost alone: texts still apart are compared by ``rest_of_groups``
    in any case. Rounds go on while pairs of those with the rest of their groups outnumber
    the texts by far, and a round brings a tenth of them home.
    """
    group, used, links, before = written(apart(group), "groups"), None, None, None
    while True:
        sizes = group.groupBy("rep").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("apart").cast("long")).alias("left"))
        size = sizes.agg(F.sum("k").alias("k"), F.sum("left").alias("left"), F.sum(F.col("k") * F.col("left")).alias("pairs")).head()
        if not size["k"] or size["pairs"] <= ROUNDS_FROM * size["k"] or (before is not None and size["left"] > 0.9 * before):
            return group, links
        before = size["left"]
        free = group.filter("not apart") if used is None else group.filter("not apart").join(used, ["rep", "n1"], "left_anti")
        next_rep = written(free.groupBy("rep").agg(F.max_by("n1", F.struct("weight", "n1")).alias("n1")), "representatives")
        used = next_rep if used is None else used.union(next_rep)
        left = written(group.filter("apart").select("rep", "root", "main", F.col("n1").alias("a")), "left")
        asked = written(inputs.spread_join(left, next_rep.withColumnRenamed("n1", "b"), "rep", "a"), "pairs")
        found = written(linked(measured(written(asked.select("a", "b").distinct(), "pairs"), sets), s.similarity), "links")
        links = found if links is None else links.union(found)
        home = asked.join(found, ["a", "b"]).groupBy("rep", "root").agg(F.first("main").alias("_home"))
        moved = group.filter("apart").join(home, ["rep", "root"], "left").withColumn("root", F.coalesce("_home", "root")).select(*group.columns)
        group = written(apart(written(group.filter("not apart").unionByName(moved), "groups")), "groups")


def rest_of_groups(group: DataFrame, star: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts of different classes in one group that may be near enough.

    Of the text r that stands for the group, and its members u and v: they have in
    common at most what each shares with r, and shingles that r lacks. Pairs near
    enough by the first alone are found by size. For others, at least
    t = similarity * n - both of a text's n - both extra shingles must be shared; with
    these in order, rarest in the group first, two texts that share as many meet
    within the first n - both - t + 1 of each. A shingle that many texts have so
    counts only for those that have none rarer.
    """
    facts = star.select(F.col("a").alias("n1"), F.col("b").alias("rep"), "both", F.col("n_a").alias("n"))
    group = written(group.select("rep", "n1", "root", "apart").join(facts, ["rep", "n1"]), "groups")
    own = sets.select("n1", F.col("shingles").alias("x"))
    of_rep = sets.select(F.col("n1").alias("rep"), F.col("shingles").alias("y"))
    lists = inputs.spread_join(group, of_rep, "rep", "n1").join(own, "n1").withColumn("e", F.array_except("x", "y"))
    lists = lists.dropDuplicates(["rep", "n1"])  # rows repeated with one doc_id and text have a set each
    extra = written(lists.select("rep", "n1", "root", "apart", "both", "n", F.explode("e").alias("s")), "extras")
    shared = extra.groupBy("rep", "s").agg(F.count(F.lit(1)).alias("k"), F.max("apart").alias("any")).filter("k > 1 and any").drop("any")
    # places count shingles of one text alone too, which come first: they fill the prefix but need no join
    alone = extra.groupBy("rep", "n1").agg(F.count(F.lit(1)).alias("size"))
    met = extra.join(shared, ["rep", "s"])
    found = met.groupBy("rep", "n1", "root", "apart", "both", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("e"))
    needed = F.greatest(F.ceil(similarity * F.col("n") - 1e-6).cast("int") - F.col("both"), F.lit(1))
    prefix = (F.col("size") - needed + 1) - (F.col("size") - F.size("e"))
    first = found.join(alone, ["rep", "n1"]).withColumn("e", F.slice("e", 1, F.greatest(prefix.cast("int"), F.lit(0))))
    first = written(first.select("rep", "n1", "root", "apart", "n", F.explode("e.s").alias("s")), "prefixes")

    ratio = (1 + similarity) / similarity
    low, high = F.ceil(similarity * F.col("n")).cast("int"), F.floor(ratio * F.col("both") - F.col("n") + 1e-9).cast("int")
    asked = group.filter("apart").filter(low <= high).withColumn("n", F.explode(F.sequence(low, high)))

    def pairs(left: DataFrame, right: DataFrame, key: list[str], able: Column) -> DataFrame:
        one, two = (d.select(*key, F.col("n1").alias(f"n1_{k}"), F.col("root").alias(f"root_{k}"), F.col("n").alias(f"size_{k}")) for d, k in ((left, "u"), (right, "v")))
        near = one.join(two, key).filter((F.col("root_u") != F.col("root_v")) & able)
        return near.select(F.least("n1_u", "n1_v").alias("a"), F.greatest("n1_u", "n1_v").alias("b"))

    like = (F.col("size_u") >= similarity * F.col("size_v") - 1e-6) & (F.col("size_v") >= similarity * F.col("size_u") - 1e-6)
    by_extra = pairs(first.filter("apart"), first, ["rep", "s"], like)
    return by_extra.union(pairs(asked, group, ["rep", "n"], F.lit(True))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """n1, root: the least vertex reachable, for vertices of edges (a, b).

    Each round takes the least root among the neighbours and then the root's root,
    and is written to the shared folder. It ends when no root changes. Links of a hub
    and members of a large class are dealt over several tasks.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("n1")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = inputs.spread_join(both, roots.withColumnRenamed("n1", "b"), "b", "a").groupBy("a").agg(F.min("root").alias("near"))
        least = written(roots.join(near, roots["n1"] == near["a"]).select("n1", "root", F.least("root", "near").alias("low")), "roots")
        upper = roots.select(F.col("n1").alias("low"), F.col("root").alias("up"))
        moved = written(inputs.spread_join(least, upper, "low", "n1").select("n1", F.col("root").alias("old"), F.least("low", "up").alias("root")), "roots")
        roots = moved.select("n1", "root")
        if not moved.filter("root < old").limit(1).count():
            return roots


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links (a, b), by the components of the classes these join."""
    ends = [roots.select(F.col("n1").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
    joined = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = written(joined.filter("a <> b").distinct(), "joined")
    if not joined.limit(1).count():
        return roots
    over = components(joined)
    # classes of the first links with their new root, and texts that had no link before
    moved = roots.join(over.select(F.col("n1").alias("root"), F.col("root").alias("_over")), "root", "left").select("n1", F.coalesce("_over", "root").alias("root"))
    return moved.unionByName(over.join(roots, "n1", "left_anti"))


def classes(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), kept, row_id, text_key, class_key.

    A class is a component of the links between texts of the asked similarity; equal
    word sequences are one text. ``kept`` marks the row of least doc_id; where all ids
    of a class are NULL, the rows of the least text hash. Rows repeated with one
    doc_id are all marked. Texts without words, NULL ones too, are one class. An empty
    table gives no rows.
    """
    s = settings or Settings()
    rows = written(signed(docs, s), "signatures")
    texts = rows.groupBy("node").agg(F.min(F.struct("row_id", "text_key")).alias("at"), F.first("n1").alias("n1"), F.first("bands").alias("bands"), F.min("doc_id").alias("low_id"))
    texts = written(texts.select("n1", "at.*", "bands", "low_id"), "texts")

    member = texts.select("n1", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = written(member.join(shared, "band"), "buckets")
    # the text that shares most bands with others stands for its bucket: in a group of copies, the one they come from
    weight = member.groupBy("n1").agg(F.sum("n").alias("weight"))
    member = written(member.join(weight, "n1"), "buckets")
    rep = member.groupBy("band").agg(F.max_by("n1", F.struct("weight", "n1")).alias("rep"))
    member = written(inputs.spread_join(member, rep, "band", "n1").groupBy("n1", "rep").agg(F.max("weight").alias("weight")), "buckets")
    pairs = member.filter("n1 <> rep").select(F.col("n1").alias("a"), F.col("rep").alias("b"))

    wanted = member.select("n1").distinct().join(texts.select("n1", "row_id", "text_key"), "n1")
    bodies = keyed(docs).join(wanted, ["row_id", "text_key"]).select("n1", "text")
    sets = written(shingle_sets(bodies, s), "shingles")
    star = written(measured(written(pairs, "pairs"), sets), "star")
    roots = components(linked(star, s.similarity))

    group = member.filter("n1 <> rep")
    group = written(group.join(roots, "n1", "left").withColumn("root", F.coalesce("root", "n1")), "groups")
    group, links = more_representatives(group, sets, s)
    found = written(linked(measured(written(rest_of_groups(group, star, sets, s.similarity), "pairs"), sets), s.similarity), "links")
    roots = merged(roots, found if links is None else links.union(found))

    least = texts.join(roots, "n1", "left").select("n1", F.coalesce("root", "n1").alias("class_key"), "low_id", F.col("row_id").alias("low_row"))
    least = written(least, "texts-classed")
    heads = least.groupBy("class_key").agg(F.min("low_id").alias("class_id"), F.min("low_row").alias("least"))
    info = inputs.spread_join(least.select("n1", "class_key"), heads, "class_key", "n1")
    at = inputs.spread_join(rows.select("doc_id", "row_id", "text_key", "n1"), written(info, "texts-classed"), "n1", "row_id")
    kept = F.when(F.col("class_id").isNull(), F.col("row_id") == F.col("least")).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
    return at.select("doc_id", "class_id", kept.alias("kept"), "row_id", "text_key", "class_key")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id, kept for every row."""
    return classes(docs, settings).select("doc_id", "class_id", "kept")


def one_of_each(docs: DataFrame, columns: list[str], settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one per class, with ``columns``."""
    kept = classes(docs, settings).filter("kept").groupBy("row_id", "text_key").agg(F.min("class_key").alias("class_key"))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), key).alias("row_id"), key.alias("text_key"), *named)
    first = Window.partitionBy("row_id", "text_key").orderBy(F.lit(0))
    one = rows.join(kept, ["row_id", "text_key"]).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
