import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from tracewright.llm import suffixes

SCHEMA = "doc_id long, text string, rk long, found string"
NULL = -(1 << 63)


def brute(rows, width):
    data = [(NULL if d is None else d, d, (t or "").encode()) for d, t, *_ in rows]
    least = {}
    for k, _, b in data:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            least[w] = min(k, least.get(w, k))
    out = []
    for k, d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample():
    rng = np.random.default_rng(8)
    draw = lambda n, a="ab é\n": "".join(rng.choice(list(a), n))
    passages = [draw(30), draw(70), draw(400), draw(49), draw(50)]
    texts = [draw(20) + passages[i % 5] + draw(i) + passages[(i * 3) % 5] for i in range(40)]
    texts += ["xy " * 400, "xy " * 300 + "z", "a" * 300, "a" * 60, "", None, passages[2], "日本語テキスト" * 30, draw(30_000, "abcdefgh "), passages[2][:200] + "!" + passages[2][200:]]
    texts += ["same text that many rows have, longer than the window of fifty bytes"] * 8
    rows = [(i * 13 % 101, t, 1, "f") for i, t in enumerate(texts)]
    rows.append((200, rows[48][1][1000:4000] + "q" + rows[48][1][:90], 0, ""))
    return rows + [rows[0], rows[0], rows[40], (None, texts[1], 0, ""), (None, "a" * 70, 0, ""), (-5, texts[2], 0, "")]


def test_remove_repeats(spark):
    rows = sample()
    for width, gram in ((50, 18), (24, 8)):
        got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), width, gram)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows, width)
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_longer_than_grams_are_split(spark, monkeypatch):
    """Windows whose bytes are a splitter's are compared across ranges, whatever the splitters."""
    rng = np.random.default_rng(3)
    draw = lambda n, a="ab": "".join(rng.choice(list(a), n))
    common = "In this article we will look at the ways in which people "
    rows = sample() + [(300 + i, draw(i % 5, "xyz\0") + common[: 20 + i % 37] + draw(3, "\0é") + draw(40) + common, 0, "") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    said = []

    def every(docs, width, gram, ranges, sample=2000):
        cut = real(docs, width, gram, 20_000) if deep else real(docs, width, gram, ranges)
        said.append(cut)
        return cut

    real = suffixes.splitters_of
    monkeypatch.setattr(suffixes, "splitters_of", every)
    for deep in (False, True):
        for width, gram in ((50, 18), (24, 8)):
            got = suffixes.remove_repeats(df, width, gram)
            assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows, width)
    assert max(len(x) for x in said[2].tolist()) == 50 and len(said[2]) > 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 * 127 for x in b)), min_size=1, max_size=60), st.integers(2, 40))
def test_cut_keys(keys, ranges):
    array = np.frombuffer(b"".join(keys), "S6")
    cut = suffixes.cut_keys(array, ranges)
    padded = [x.ljust(6, b"\0") for x in cut.tolist()]
    assert padded == sorted(set(padded)) and len(padded) < ranges
    route = np.searchsorted(cut, array, "right")
    assert route.tolist() == [sum(c <= k for c in padded) for k in keys]
    reach = suffixes._reach(array, route, cut, 2)
    for k, got in zip(keys, reach.tolist(), strict=True):
        most = max([next((i for i in range(6) if c[i] != k[i]), 6) for c in padded], default=0)
        assert got == (most if most >= 2 else 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=40))
def test_multikey(rows):
    digits = np.array(rows, np.uint64)
    order, shared = suffixes.multikey_order(digits)
    done = digits[order].tolist()
    assert done == sorted(rows)
    for a, b, s in zip(done, done[1:], shared[1:].tolist(), strict=False):
        assert s == next((i for i in range(3) if a[i] != b[i]), 3)


def test_exact_fallback():
    windows = np.frombuffer(b"aabbaacc", np.uint8).reshape(4, 2)
    assert suffixes._exactly(windows, np.array([3, 1, 2, 5])).tolist() == [True, False, False, False]


def test_first_seen_compares_bytes():
    """Keys that meet do not make stretches equal."""
    rng = np.random.default_rng(4)
    seen = suffixes.FirstSeen(most=400)
    first, forgotten = {}, 0
    for d0 in range(0, 60, 3):
        data = rng.integers(0, 2, 400).astype(np.uint8)
        start = np.sort(rng.integers(0, 390, 80))
        size = rng.integers(3, 8, 80)
        d = d0 + np.arange(80) // 30
        words = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
        keys = np.array([len(w) * 7 + w[0] * 3 + w[1] for w in words], np.uint64)  # many words have one key
        got = seen.smaller(keys, d, data, start, size)
        for w, x, g in zip(words, d.tolist(), got.tolist(), strict=True):
            assert not g or first.get(w, x) < x
            forgotten += not g and first.get(w, x) < x
            first[w] = min(x, first.get(w, x))
    seen = suffixes.FirstSeen()
    data = np.frombuffer(b"abcabcabd", np.uint8)
    start, size = np.array([0, 3, 6]), np.array([3, 3, 3])
    assert seen.smaller(np.array([1, 1, 1], np.uint64), np.array([1, 2, 3]), data, start, size).tolist() == [False, True, False]
    assert seen.smaller(np.array([1, 1], np.uint64), np.array([4, 4]), data, start[1:], size[1:]).tolist() == [True, False]


def test_limits_of_width(spark):
    import pytest

    for width, gram in ((100, 18), (50, 4), (10, 18)):
        with pytest.raises(ValueError, match="gram"):
            suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), width, gram)
