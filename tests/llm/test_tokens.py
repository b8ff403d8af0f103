"""Shards and packing against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tracewright.llm import packing, sstable
from tracewright.llm.bpe import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens long, length int, key string"
TEXTS = ["", " ", "  ", "a  ", "a \n b", "a\n \nb", "it's we'LL I'd  x", "日本 語 テスト x   y", "x<|endoftext|>y", "a\x1c b \x85 c", "é ﬁ ² ³ ª x", " lead", "tab\t tab \t x", "a\n ", "1234 56a b7'", "ſ ʼn ’s", None, "same text", "same text", "long words here. " * 3000]


def rows():
    return [(i * 7 % 40, t, 1, 2, "k") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, 1, None), (7, "repeat of an id", 0, 0, "")]


def expected(text):
    return np.array(Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder_equals_library():
    e = Encoder(VOCABULARY, cached=5)
    for t in TEXTS:
        assert np.frombuffer(e.encode(t or ""), e.dtype).tolist() == expected(t)[:-1].tolist()


def test_shards_round_trip(spark, tmp_path):
    data = rows()
    folder = str(tmp_path / "s")
    manifest = sstable.write_shards(spark.createDataFrame(data, SCHEMA), folder, VOCABULARY, 2, shards=3)
    got = [tuple(r) for r in sstable.read_shards(manifest).collect()]
    want = sorted((-1 if d is None else d, len(i := expected(t)), zlib.crc32(i)) for d, t, *_ in data)
    assert sorted((-1 if d is None else d, n, c) for d, _, n, c in got) == want
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((d for d, *_ in data), key=lambda d: (d is not None, d or 0))
    readers = [sstable.ShardReader(r.path) for r in manifest.collect()]
    for d, t, *_ in data:
        found = [i.tolist() for r in readers for i in r.get(d)]
        assert expected(t).tolist() in found
    assert not [i for r in readers for i in r.get(10**12)]


def test_shards_of_nothing(spark):
    assert sstable.token_shards(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def test_blocks_and_restarts(tmp_path):
    w = sstable.ShardWriter(str(tmp_path / "x.sst"), 2, block_bytes=500)
    for i in range(0, 4000, 2):
        w.add(sstable.key_of(i - 1000), np.arange(i % 7, dtype="<u2").tobytes())
    w.finish()
    r = sstable.ShardReader(str(tmp_path / "x.sst"))
    assert len(r.blocks) > 10 and r.entries == 2000
    assert all(r.get(i - 1000)[0].tolist() == list(range(i % 7)) for i in range(0, 4000, 2))
    assert not any(r.get(i - 1000) for i in range(1, 4000, 2))


def test_packing(spark):
    data = rows()
    got = [tuple(r) for r in packing.pack(spark.createDataFrame(data, SCHEMA), VOCABULARY, 2, 64).collect()]
    whole = {}
    for d, piece, start, length, crc, _, _ in got:
        whole.setdefault(d, []).append((piece, start, length, crc))
    pieces = []
    for d, t, *_ in data:
        ids, at = expected(t), 0
        first = (len(ids) - 1) % 64 + 1
        for k, to in enumerate(range(first, len(ids) + 1, 64)):
            pieces.append((d, k, at, to - at, zlib.crc32(ids[at:to])))
            at = to
    assert sorted(map(str, pieces)) == sorted(str(r[:5]) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    counts = np.bincount([p[3] for p in pieces], minlength=65)
    assert packing.lower_bound(counts) <= len(bins) <= sum(t for _, t in packing.best_fit(counts))


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def test_bin_completion_beats_best_fit():
    """3+3+4 twice fill two bins of ten exactly; best fit joins the fours and needs three."""
    counts = np.bincount([4, 4, 3, 3, 3, 3], minlength=11)
    assert sum(t for _, t in packing.best_fit(counts)) == 3
    assert sum(t for _, t in packing.bin_completion(counts)) == 2


def test_bin_completion_finds_planted_packings():
    """Three pieces a bin that fill it exactly: best fit finds none of these, the search most."""
    rng = np.random.default_rng(1)
    met = best = 0
    for bins in (5, 7, 9, 12, 16, 46, 54, 59):
        a, b = np.sort(rng.choice(np.arange(1, 1024), (bins, 2)), axis=1).T
        keep = a < b
        sizes = np.concatenate([a[keep], (b - a)[keep], (1024 - b)[keep]])
        counts = np.bincount(sizes, minlength=1025)
        plan = packing.bin_completion(counts, nodes=1500, steps=200)
        held = np.zeros(1025, int)
        for filling, times in plan:
            assert sum(s * k for s, k in filling) <= 1024
            for s, k in filling:
                held[s] += k * times
        assert (held == counts).all()
        met += packing.bins_of(plan) == keep.sum()
        best += packing.bins_of(packing.best_fit(counts)) == keep.sum()
        assert packing.bins_of(plan) <= packing.bins_of(packing.best_fit(counts))
    assert met >= 5 > best


def test_search_is_the_same_for_many_bins():
    """Planted packings of over 100 bins are searched as a whole, like small ones."""
    for seed, bins, times in ((1, 110, 1), (1, 12, 9), (1, 16, 40)):
        a, b = np.sort(np.random.default_rng(seed).choice(np.arange(1, 1024), (bins, 2)), axis=1).T
        keep = a < b
        counts = times * np.bincount(np.concatenate([a[keep], (b - a)[keep], (1024 - b)[keep]]), minlength=1025)
        plan = packing.bin_completion(counts)
        held = np.zeros(1025, int)
        for filling, n in plan:
            assert sum(s * k for s, k in filling) <= 1024
            for s, k in filling:
                held[s] += k * n
        assert (held == counts).all()
        assert packing.bins_of(plan) == times * keep.sum() > 100


def test_fillings_are_undominated():
    stock = packing.Stock({7: 1, 4: 2, 3: 2, 2: 1, 6: 1}, 13)
    found = stock.fillings(6, 3, 99, 10_000)
    assert (0, ((7, 1), (6, 1))) in found and (0, ((6, 1), (4, 1), (3, 1))) not in found
    assert all(sum(s * k for s, k in f) == 13 - w for w, f in found)
