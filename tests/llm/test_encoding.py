"""Byte-level BPE, token counts, packing: against the libraries and small brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from callweave.llm import bpe, packing, token_count
from callweave.llm.queries import QUERIES, tokenizer_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.one_of(st.sampled_from("ab \n\t'sé漢😀12▁"), st.characters(exclude_categories=["Cs"])), max_size=80)
ODD = ["", " ", "\n\n  \n", "a" * 3000, "x" * 200 + " " * 200 + "é" * 100, "it's I'LL 12345 ###", "<|endoftext|>", "\0\x01", "▁▁ a▁b"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(codec, library, text):
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_exact(codec):
    h = codec.whole
    assert h.n == len(codec.ranks) and None not in h.keys
    assert all(h.get(k) == v for k, v in codec.ranks.items())
    assert all(h.get(f"no such entry {i}".encode()) is None for i in range(500))
    assert bpe.PerfectHash({b"a": 5}).get(b"a") == 5 and bpe.PerfectHash({}).get(b"a") is None


def test_cache_stays_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i}" for i in range(500))
    assert own.encode(text) == codec.encode(text) and len(own) <= 50


def test_bpe_frames(spark):
    texts = [*ODD, None, ODD[3]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_library(byte_fallback):
    pieces, unknown = token_count.vocabulary(PIECES)
    library = Tokenizer(models.Unigram(pieces, unknown, byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_count.Counter(pieces, unknown, byte_fallback)
    rng = random.Random(7)
    texts = [*ODD, *("".join(rng.choice("abc teion \n'é漢😀1▁<0x>") for _ in range(rng.randint(0, 70))) for _ in range(1500))]
    assert [own.total(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_ties_and_unknown_runs():
    """Equal scores: the longer last piece stands. Unknown neighbours are one piece."""
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("ab", -2.5)]
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_count.Counter(pieces, 0, False)
    for text in ("aaaa", "aaab", "zz", "azza", "zzazz z", "a" * 9 + "zz"):
        assert own.total(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_frame(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in token_count.counted(docs, PIECES).collect())
    assert got[:2] == [(1, 0, 0), (2, 0, 0)] and got[2] == got[3] and got[2][1] == 11
    assert token_count.counted(docs.limit(0), PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 3))
def test_packing_ids_equal_tokenizers(text, specials):
    text = "<|endoftext|>".join([text] * (specials + 1))
    library = _tokenizers()
    assert packing.tokenizer(*tokenizer_files())(text).tolist() == library.encode(text, add_special_tokens=False).ids


_KEPT: list[Tokenizer] = []


def _tokenizers() -> Tokenizer:
    if not _KEPT:
        _KEPT.append(Tokenizer.from_file(tokenizer_files()[1]))
    return _KEPT[0]


def _fewest(sizes: list[int], capacity: int) -> int:
    best = len(sizes)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_bounds_hold(case):
    capacity, sizes = case
    sizes = sorted(sizes, reverse=True)
    array = np.array(sizes, np.int64)
    bins, offsets, fill = packing.best_fit(array, capacity)
    assert packing.lower_bound(array, capacity) <= _fewest(sizes, capacity) <= len(fill) if sizes else not len(fill)
    seen: dict[int, int] = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), sizes, strict=True):
        assert o == seen.get(b, 0)
        seen[b] = o + n
        assert seen[b] <= capacity


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("group", [packing.GROUP, 30])
def test_packed(spark, monkeypatch, group):
    """Whole, gapless, checksummed; small groups exchange until few bins are wasted."""
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(120)] + [(500, None), (None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sequence_id string, length int")
    out = packing.packed(docs, tokenizer_files(), 64).collect()
    encode = packing.tokenizer(*tokenizer_files())
    want = []
    for key, text in rows:
        ids = np.append(encode(text or ""), 2).astype("<u4")
        want += [(key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 64))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], key=repr) == sorted(want, key=repr)
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 64
    full = sum(r["length"] == 64 for r in out)
    rest = np.array(sorted((r["length"] for r in out if r["length"] < 64), reverse=True), np.int64)
    assert full + packing.lower_bound(rest, 64) <= len(by) <= full + len(packing.best_fit(rest, 64)[2]) + (0 if group > 1000 else 3)


def test_packed_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_files()).count() == 0


def test_packed_query_is_near_the_bound(spark):
    out = QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.001").select("sequence_id", "length").collect()
    assert len({r["sequence_id"] for r in out}) <= -(-sum(r["length"] for r in out) // 1024) + 2


RUNS = [" " * 2_000_000 + "end", "a" + "\n" * 2_000_000, "x" + " " * 60_000 + "<|endoftext|>" + "\t" * 50_000 + " 's", "#" * 200_000 + "\u3000" * 50_000 + "é", "\x85" * 50_001, "a" * 100_000 + " " * 49_999 + "b" + " " * 50_000 + "\r"]


@pytest.mark.parametrize("k", range(len(RUNS)))
def test_packing_ids_of_long_runs(k):
    """White space and symbols in runs that a backtracking engine gives up on, against the tokenizers library."""
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(RUNS[k], add_special_tokens=False).ids
    assert packing.tokenizer(*tokenizer_files())(RUNS[k]).tolist() == want


def test_packing_a_table_with_long_runs_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate([RUNS[0], RUNS[1], None, "", "a b"])], "doc_id int, text string, row int, piece int, length int")
    rows = packing.packed(docs, tokenizer_files()).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 1024 and all(o == sum(n for p, n in v if p < o) for o, _ in v) for v in ends.values())
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 2_000_001  # the blanks but one, " end", the end


def test_any_integer_doc_id(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (None, "c", 8)], "doc_id int, text string, ids_sha256 int")
    rows = bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {1: 2, None: 1}


def test_long_texts_are_counted_whole(spark):
    docs = spark.createDataFrame([(1, "ab " * 300_000), (2, "q" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in token_count.counted(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    once = token_count.counter(public_tokenizers.path("piece_bpe_32k.model"), True)
    assert got[1] == (900_000, 300_000 * once["ab"] + once[""]) and got[2] == (200_000, once.count("▁" + "q" * 200_000))
