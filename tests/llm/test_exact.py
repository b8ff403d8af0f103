import hashlib
import re

from hypothesis import given, settings, strategies as st

from tracewright.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, h long"


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(n, []).append(d)
    out = []
    for n, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(str(d), str(keep), len(ids), d == keep, hashlib.sha256(n.encode()).hexdigest()) for d in ids]
    return sorted(out)


def test_groups(spark):
    texts = ["a b", "a  b", "a\n\tb", " a b", "a b ", "", None, "   ", "\n", "a\u00a0b", "é", "e\u0301", "x" * 300_000, "x" * 299_999 + "y", "x" * 300_000]
    rows = [(i * 5 % 17, t, "k", 1) for i, t in enumerate(texts)] + [(3, "a b", "k", 1), (3, "a b", "k", 1), (None, "a b", "", 1), (None, "only null", "", 2)]
    got = sorted((str(a), str(b), c, d, e) for a, b, c, d, e in exact.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    left = exact.drop_copies(spark.createDataFrame(rows[:15], SCHEMA))
    assert left.columns == ["doc_id", "text", "keep_id", "h"] and left.count() == sum(r[3] for r in brute(rows[:15]))


def test_drop_judges_each_row(spark):
    rows = [(3, "Y"), (5, "X"), (5, "Y"), (1, "a b"), (None, "a  b"), (None, "only here"), (None, None), (7, ""), (None, "both null"), (None, "both null"), (3, "Y")]
    left = exact.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"]
    want = [(3, "Y"), (3, "Y"), (5, "X"), (1, "a b"), (None, "only here"), (7, ""), (None, "both null"), (None, "both null")]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want)) and len(want) == sum(r[3] for r in brute(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12).map(str.encode), max_size=60))
def test_trie_with_spills(tmp_path_factory, texts):
    trie = exact.SpillingTrie(900, str(tmp_path_factory.mktemp("t")))
    want = {}
    for i, t in enumerate(texts):
        trie.insert(t, i, 1)
        o, n = want.get(t, (i, 0))
        want[t] = (o, n + 1)
    assert {t: (o, n) for t, o, n in trie.items()} == want


def test_single_texts_over_the_limit(tmp_path, monkeypatch):
    """Texts longer than the limit are never spilled alone, and each file is read once."""
    opened = []
    real = exact.filesystem

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def open_input_stream(self, path):
            opened.append(path)
            return self.fs.open_input_stream(path)

    monkeypatch.setattr(exact, "filesystem", lambda uri: (Watched(real(uri)[0]), real(uri)[1]))
    long = b"a" * 50_000
    for texts in ([long], [long, long + b"b"], [long + b"b", long], [long + b"b", b"c" * 50_000], [b"", long, long[:40_000], b"b" + long, b"bb" + long]):
        opened.clear()
        trie = exact.SpillingTrie(1000, str(tmp_path / "t"))
        for i, t in enumerate(texts * 2):
            trie.insert(t, i, 1)
        assert sorted(trie.items()) == sorted((t, i, 2) for i, t in enumerate(texts))
        assert len(opened) == len(set(opened)) < len(texts) * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), max_size=30), st.integers(1, 2000))
def test_spilling_keeps_all(texts, limit):
    import tempfile
    from collections import Counter

    with tempfile.TemporaryDirectory() as folder:
        trie = exact.SpillingTrie(limit, folder)
        for i, t in enumerate(texts):
            trie.insert(t, i, 1)
        assert sorted(trie.items()) == sorted((t, texts.index(t), n) for t, n in Counter(texts).items())


def test_group_of_long_texts(spark):
    rows = [(3, "x" * 40_000), (1, "x" * 40_000), (2, "x" * 39_999 + "y")]
    got = {r.text_sha256: (r.keep_id, r.group_size) for r in exact.owners(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): v for t, v in ((rows[0][1], (1, 2)), (rows[2][1], (2, 1)))}
