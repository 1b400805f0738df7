"""Source divergence audit (operator 11): how far the term shares of each source of
a language lie from those of its other sources and of the whole language.

Terms are counted in two rounds. Every task counts the terms of its own rows by
(language, source) as packed words (``packed``) and hands on one row per language,
block and bucket; blocks are dealt by a hash of the term, so a hot language or source
is spread over all of them. A block then holds every count of its terms, and all that
follows, term selection, sums of pairs and the best terms, is done block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import inputs
from .packed import Bag, blocks_of, count_runs, joined, radix_order, run_starts, runs, unpacked

#: Bytes of text that are sorted at once.
STEP_BYTES = 8 << 20
#: Rows of a task's counts that are held before they are merged, and handed on if merging leaves more than half.
HELD_ROWS = 2_000_000
#: Numbers in one intermediate table of a block.
CELLS = 1 << 20

#: Lower-cased byte of a letter, any byte beyond ASCII as it is, zero for the rest.
CODES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

PARTIAL = "lang string, block int, bucket int, sources array<string>, keys binary, source binary, n binary, docs binary"
_PARTIAL = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("bucket", pa.int32()), ("sources", pa.list_(pa.string())), *((c, pa.binary()) for c in ("keys", "source", "n", "docs"))])
BLOCK = "lang string, block int, sources array<string>, totals array<long>, terms array<string>, term array<int>, source array<int>, n array<long>"
_BLOCK = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
                    ("term", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
FOUND = "lang string, source string, sums array<long>, terms array<string>, excess array<long>"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("sums", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("excess", pa.list_(pa.int64()))])
RANKED = "lang string, source string, part string, item string, value long, rank int"
_RANKED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("rank", pa.int32())])


@dataclass(frozen=True)
class Settings:
    """``blocks`` is the number of blocks per language; None takes the session's
    shuffle partitions, which a deployment sets by the size of its data."""

    least_docs: int = 3
    scale: int = 1_000_000_000
    top: int = 200
    blocks: int | None = None


def plain(docs: DataFrame) -> DataFrame:
    """lang, source and text of each row, NULL as ''."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(docs: DataFrame, blocks: int) -> DataFrame:
    """Counts of each task: terms of a (language, block, bucket) with occurrences and documents by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        bag = Bag()

        def hand_on() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
            lang_of = np.array([langs[lang] for lang, _ in names], np.int64)
            for bucket, keys, group, (n, docs) in bag.items():
                cell = lang_of[group] * blocks + blocks_of(keys, blocks)
                order = radix_order([cell])
                bounds = run_starts([cell[order]])
                rows = []
                for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
                    at = order[lo:hi]
                    used, local = np.unique(group[at], return_inverse=True)
                    lang, block = divmod(int(cell[at[0]]), blocks)
                    rows.append((names[used[0]][0], block, bucket, [names[g][1] for g in used], b"".join(k[at].tobytes() for k in keys), local.astype("<i4").tobytes(), n[at].astype("<i8").tobytes(), docs[at].astype("<i8").tobytes()))
                yield inputs.record(_PARTIAL, zip(*rows, strict=True))
            bag.clear()
            groups.clear()

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            step = np.cumsum(sizes) // STEP_BYTES
            for first, last in zip(run_starts([step]).tolist(), [*run_starts([step])[1:].tolist(), batch.num_rows], strict=True):
                rows = batch.slice(first, last - first)
                group = np.array([groups.setdefault(k, len(groups)) for k in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)], np.int64)
                order = radix_order([group])
                data, begins = joined(rows.column(2).take(pa.array(order)))
                codes = CODES[data]
                starts, lengths = runs(codes)
                if len(starts):
                    doc = np.searchsorted(begins, starts, "right") - 1
                    count_runs(bag, codes, starts, lengths, group[order][doc], doc)
                if bag.rows > HELD_ROWS:
                    bag.compact()
                    if bag.rows > HELD_ROWS // 2:
                        yield from hand_on()
        bag.compact()
        yield from hand_on()

    return plain(docs).mapInArrow(run, PARTIAL)


def _keys(blob: bytes, bucket: int, rows: int) -> list[np.ndarray]:
    """The key columns that ``counted`` wrote for a bucket."""
    if len(blob) == rows * bucket and bucket > 8:
        return [np.frombuffer(blob, f"S{bucket}")]
    return list(np.frombuffer(blob, np.uint64).reshape(-1, rows))


def kept_terms(partial: DataFrame, least_docs: int) -> DataFrame:
    """Per language and block: its terms in at least ``least_docs`` documents, in byte
    order, and their occurrences by source, as places in ``terms`` and ``sources``."""

    def merge(rows: pa.Table) -> pa.Table:
        sources: dict[str, int] = {}
        bag = Bag()
        for r in rows.to_pylist():
            local = np.array([sources.setdefault(s, len(sources)) for s in r["sources"]], np.int64)
            group = local[np.frombuffer(r["source"], "<i4")]
            bag.add(r["bucket"], _keys(r["keys"], r["bucket"], len(group)), group, [np.frombuffer(r["n"], "<i8"), np.frombuffer(r["docs"], "<i8")])
        bag.compact()
        terms: list[bytes] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for bucket, keys, group, (n, docs) in bag.items():
            first = run_starts(keys)
            enough = np.add.reduceat(docs, first) >= least_docs
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
            rank = np.cumsum(enough) - 1 + len(terms)
            keep = enough[which]
            found.append((rank[which][keep], group[keep], n[keep]))
            terms += unpacked([k[first[enough]] for k in keys]).tolist()
        if not terms:
            return _BLOCK.empty_table()
        term, group, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        totals = np.zeros(len(sources), np.int64)
        np.add.at(totals, group, n)
        row = [rows["lang"][0].as_py(), rows["block"][0].as_py(), list(sources), totals, [terms[i].decode() for i in order], place[term], group, n]
        return pa.Table.from_batches([inputs.record(_BLOCK, [pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)])])

    return partial.groupBy("lang", "block").applyInArrow(merge, BLOCK)


def shares(n: np.ndarray, total: np.ndarray | int, terms: int, scale: int) -> np.ndarray:
    return 1 + scale * (n + 1) // (total + terms)


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(term: np.ndarray, source: np.ndarray, n: np.ndarray, n_terms: int, totals: np.ndarray, v: int, scale: int) -> np.ndarray:
    """[s, t]: the excess of source s over source t, summed over all terms of a block.

    Counts are given where they are not zero, so for each s the sum over all terms
    against t's share of an unseen term is taken first, from the distinct shares of s;
    the terms that t has are then exchanged for their own shares.
    """
    order = radix_order([source.astype(np.uint64)], term)
    term, source, n = term[order], source[order], n[order]
    unseen = shares(np.zeros(len(totals), np.int64), totals, v, scale)
    p = shares(n, totals[source], v, scale)
    first = run_starts([source])
    bounds = {int(source[a]): (a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(source)], strict=True)}
    sums = np.zeros((len(totals), len(totals)), np.int64)
    own = np.empty(n_terms, np.int64)
    for s in range(len(totals)):
        a, b = bounds.get(s, (0, 0))
        value, times = np.unique(p[a:b], return_counts=True)
        value, times = np.append(value, unseen[s]), np.append(times, n_terms - (b - a))
        for lo in range(0, len(value), max(1, CELLS // len(totals))):
            part = slice(lo, lo + max(1, CELLS // len(totals)))
            sums[s] += (excess(value[part, None], unseen[None, :]) * times[part, None]).sum(0)
        own[:] = unseen[s]
        own[term[a:b]] = p[a:b]
        mine = own[term]
        sums[s, source[first]] += np.add.reduceat(excess(mine, p) - excess(mine, unseen[source]), first)
    return sums


def best_terms(term: np.ndarray, source: np.ndarray, n: np.ndarray, n_terms: int, totals: np.ndarray, v: int, scale: int, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, term, excess over the language) of the first ``top`` terms of each
    source that has them more often than the language."""
    whole = np.zeros(n_terms, np.int64)
    np.add.at(whole, term, n)
    p, q = shares(n, totals[source], v, scale), shares(whole, totals.sum(), v, scale)[term]
    over = p > q
    term, source, value = term[over], source[over], excess(p[over], q[over])
    order = np.lexsort((term, -value, source))
    term, source, value = term[order], source[order], value[order]
    first = run_starts([source])
    rank = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
    return source[rank < top], term[rank < top], value[rank < top]


def block_results(blocks: DataFrame, profiles: DataFrame, s: Settings) -> DataFrame:
    """A row per block and source: its sums over the sources of the language, in the
    order of the profile, and its candidate terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                value = lambda c: r.column(r.schema.get_field_index(c))[0]  # noqa: B023, E731
                flat = lambda c: value(c).values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                names, lang = value("all_sources").as_py(), value("lang").as_py()
                place = {x: k for k, x in enumerate(names)}
                source = np.array([place[x] for x in value("sources").as_py()], np.int64)[flat("source")]
                entry = flat("term").astype(np.int64), source, flat("n"), len(value("terms"))
                totals, v = flat("all_totals").astype(np.int64), value("v").as_py()
                sums = pair_sums(*entry, totals, v, s.scale)
                src, term, excesses = best_terms(*entry, totals, v, s.scale, s.top)
                words = value("terms").values.take(pa.array(term))
                bounds = np.searchsorted(src, np.arange(len(names) + 1))
                step = max(1, CELLS // len(names))
                for lo in range(0, len(names), step):
                    part = range(lo, min(lo + step, len(names)))
                    cut = [slice(bounds[x], bounds[x + 1]) for x in part]
                    yield inputs.record(_FOUND, [[lang] * len(part), [names[x] for x in part], list(sums[part.start : part.stop]), [words[c].to_pylist() for c in cut], [excesses[c] for c in cut]])

    # one copy of a language's profile per block: the key is never hot
    given = blocks.select("lang", "block").join(profiles, "lang").withColumnsRenamed({"sources": "all_sources", "totals": "all_totals"})
    return blocks.join(given, ["lang", "block"]).mapInArrow(run, FOUND)


def ranked(found: DataFrame, profiles: DataFrame, top: int) -> DataFrame:
    """The rows of the audit, a group per source of a language: a row per block, added up
    number by number, so no pair of sources is a row before it is one of the result."""

    def merge(rows: pa.Table) -> pa.Table:
        lang, source = rows["lang"][0].as_py(), rows["source"][0].as_py()
        names = next(x for x in rows["names"] if x.is_valid).as_py()
        sums = np.zeros(len(names), np.int64)
        for x in rows["sums"]:
            if x.is_valid:
                sums += x.values.to_numpy()
        value = lambda c: [x for part in rows[c].to_pylist() if part for x in part]
        pairs = [(n, x) for n, x in zip(names, sums.tolist(), strict=True) if n != source]
        out: list[tuple] = []
        for part, items, most in (("pair", pairs, len(pairs)), ("term", list(zip(value("terms"), value("excess"), strict=True)), top)):
            items.sort(key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
            out += [(lang, source, part, item, n, rank) for rank, (item, n) in enumerate(items[:most], 1)]
        return pa.Table.from_batches([inputs.record(_RANKED, zip(*out, strict=True))] if out else [], _RANKED)

    given = profiles.select("lang", F.explode("sources").alias("source"), "sources")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    given = given.select("lang", "source", none("sums", "array<long>"), none("terms", "array<string>"), none("excess", "array<long>"), F.col("sources").alias("names"))
    return found.withColumn("names", F.lit(None).cast("array<string>")).unionByName(given).groupBy("lang", "source").applyInArrow(merge, RANKED)


def audit(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
    language keeps the V terms that stand in at least ``least_docs`` of its rows. A group with N
    occurrences of kept terms gives a term that it has n times the share
    p = 1 + floor(scale * (n + 1) / (N + V)); the excess of p over a share q is
    floor((p - q)^2 / q). ``pair`` rows give the excess of a source over each other source of
    its language, summed over all kept terms; ``term`` rows the terms of a source whose
    share exceeds the language's, the first ``top``. Ranks go by value, then by the
    item's bytes.

    NULL text, lang and source are read as ''. Every row is a document of its own,
    repeated rows too. Sources without terms have their pairs; a language without
    kept terms gives 0 for each pair; the only source of a language has no pairs.
    An empty table gives no rows. Columns other than text, lang and source are not read.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    blocks = s.blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(kept_terms(counted(docs, blocks), s.least_docs), "term-blocks")

    groups = plain(docs).select("lang", "source").distinct()
    totals = held.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", "x.sources").agg(F.sum("x.totals").alias("total"))
    totals = groups.join(totals.withColumnRenamed("sources", "source"), ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")).alias("x"))
    # one row per language; a pair of its sources is a row of the result, so the list is short beside that
    profiles = totals.groupBy("lang").agg(F.array_sort(F.collect_list("x")).alias("x"))
    terms = held.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    profiles = profiles.join(terms, "lang", "left").select("lang", F.col("x.source").alias("sources"), F.col("x.total").alias("totals"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    profiles = written(profiles, "term-profiles")

    return ranked(written(block_results(held, profiles, s), "term-results"), profiles, s.top)
