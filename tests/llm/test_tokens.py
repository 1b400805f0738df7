"""Operators 3, 6, 7 and 10 against the libraries."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus import empty, odd, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseloom.llm import counts, packing, pieces, token_files
from caseloom.llm.elias_fano import EliasFano
from caseloom.llm.piece_model import CharacterMap, PieceModel, fields
from caseloom.llm.tokens import ChunkEncoder, safe_pieces

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\t", "é", "é", "'s", "12", "###", "\x1c", " ", "<|endoftext|>", "\U0001f600", "\x00", ".", "İ", "Σ"]), max_size=14).map("".join)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_ids_of_the_library(path):
    encoder, library = ChunkEncoder(path, limit=60_000), Tokenizer.from_file(path)
    assert encoder.kind == {BYTES: "spaced", WORDS: "dropped"}[path]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXTS, max_size=4))
    def check(texts):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, encoder.type).tolist() for b in encoder.encode(texts)] == want

    check()


def test_texts_cut_at_safe_places_have_the_pieces_of_the_whole():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(TEXTS, max_size=12).map(" ".join), st.integers(2, 30))
    def check(text, most):
        assert [i for p in safe_pieces(text, most) for i in library.encode(p)] == library.encode(text)

    check()


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}])
def test_character_map_normalises_as_the_library(rule, flags):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    spec = next(dict(fields(v)) for n, v in fields(library.serialized_model_proto()) if n == 3)
    model = PieceModel.__new__(PieceModel)
    model.map, model.prefix, model.trims, model.escapes = CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    for text in ["", " a  b ", "Ｈｅｌｌｏ　ﬁne ①②", "½ ㌀ ｶﾞ", "x\ty\nz", "한글 한", "​ a", "tion’s “q” …"]:
        normal, source = model.normalise(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_spans_are_those_of_the_library():
    model = PieceModel(PIECES)
    for text in ["Hello wörld  \U0001f600 é\n x", " lead", "a", "trail ", "\t"]:
        ids = np.array(model.library.encode(text))
        starts, ends = model.spans(text, ids)
        proto = model.library.encode(text, return_type="proto").pieces
        chars = [p for p in proto if p.id not in range(3, 259)]  # byte pieces of one character share its span there
        mine = [(s, e) for s, e, p in zip(starts.tolist(), ends.tolist(), proto, strict=True) if p.id not in range(3, 259)]
        assert mine == [(p.begin, p.end) for p in chars]
        assert b"".join(text.encode()[s:e] for s, e in zip(starts, ends, strict=True)) == text.encode()


def test_pieces_of_odd_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = collections.Counter()
    for i, text, *_ in odd_rows():
        ids = library.encode(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    rows = pieces.encode_digests(odd(spark), PIECES).collect()
    assert collections.Counter(tuple(r[:4]) for r in rows) == want and all(r["spans_tile"] for r in rows)
    full = pieces.encode(odd(spark), PIECES)
    back = pieces.decode(full, PIECES).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((r["doc_id"], r["decoded"]) for r in full.collect())
    assert pieces.encode_digests(empty(spark), PIECES).count() == pieces.encode(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_token_counts_of_odd_texts(spark, path):
    if path == PIECES:
        library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        size = lambda t: len(library.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = collections.Counter((i, len((t or "").encode()), size(t or ""), size(t or "") > 100) for i, t, *_ in odd_rows())
    assert collections.Counter(map(tuple, counts.token_counts(odd(spark), path, limit=100).collect())) == want
    assert counts.token_counts(empty(spark), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = np.cumsum(np.array(values, np.int64) % 5000) if len(values) % 2 else np.sort(np.array(values, np.int64))
    code = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert code.values().tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert code.select(i) == values[i]


def test_elias_fano_is_near_the_least_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    bits = 8 * len(EliasFano.build(ends).to_bytes()) / len(ends)
    assert bits < 3 + np.log2(ends[-1] / len(ends))


def test_token_files_give_every_document_back(spark, tmp_path):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = str(tmp_path / "ids")
    token_files.write_ids(odd(spark).repartition(3), path, BYTES, segment_ids=500)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want
    sums = sorted(token_files.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in sums] == [(i, s, n, zlib.crc32(b)) for i, s, n, b in want]
    segment = spark.read.parquet(path).orderBy("slice", "segment").first().asDict()
    keys, starts, ends = token_files.boundaries(segment)
    assert [token_files.document(segment, i).tolist() for i in range(len(keys))] == [np.frombuffer(b, "<u4").tolist() for *_, b in want[: len(keys)]]
    assert token_files.round_trip(empty(spark), BYTES).count() == 0


def packed(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_texts(spark):
    rows = packing.pack(odd(spark), WORDS, capacity=64).collect()
    library, want = Tokenizer.from_file(WORDS), collections.Counter()
    for i, text, *_ in odd_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            want[i, n, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    packed(rows, 64)
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 30)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        chosen = packing.fullest(np.bincount(items, minlength=31), room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(items.count(n) >= k for n, k in chosen.items())


def test_bins_are_near_the_bound_and_hot_lengths_are_spread(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(3000)] + [37] * 3000
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.assign(parts, capacity=100, ranked_rows=50).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(lengths)
    assert packed(rows, 100) <= 1.05 * max(sum(lengths) / 100, sum(n > 50 for n in lengths) + sum(33 < n <= 50 for n in lengths) / 2.5)


def test_plan_is_short_whatever_the_number_of_pieces():
    plan = packing.patterns({2048: 10**12, 1000: 10**9, 48: 10**9, 7: 3}, 2048)
    assert len(plan) < 20 and sum(bins for _, bins in plan) >= 10**12
    used = collections.Counter()
    for chosen, bins in plan:
        for n, k in chosen.items():
            used[n] += k * bins
    assert used == {2048: 10**12, 1000: 10**9, 48: 10**9, 7: 3}
