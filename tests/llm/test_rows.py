"""Word pieces, leaks and toxicity against brute force."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracewright.llm import decontaminate, toxicity, wordpiece

SCHEMA = "doc_id long, text string, toxic int, item_id string"


def greedy(word, first, rest):
    at, n = 0, 0
    while at < len(word):
        held = first if not at else rest
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in held), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


pieces = st.frozensets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces, st.lists(st.text("abcd", max_size=12).map(str.encode), max_size=10))
def test_automaton_is_greedy(first, rest, words):
    a = wordpiece.Automaton(first, rest)
    assert [a.count(w) for w in words] == [greedy(w, first, rest) for w in words]


def test_token_counts(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    first, rest = map(set, wordpiece.byte_bpe_pieces(path))
    texts = [None, "", " \n", "Hello world", "thntblere of é 日本語 x\x0by" * 3, "a" * 5000, "Hello world", "\x00 \x85"]
    rows = [(i, t, 0, "k") for i, t in enumerate(texts)] + [(None, "x y", 1, ""), (3, "Hello world", 0, "")]
    got = sorted(map(str, (tuple(r) for r in wordpiece.token_counts(spark.createDataFrame(rows, SCHEMA), path).collect())))
    want = [(d, len((t or "").encode()), len(w := (t or "").encode().split()), sum(greedy(b" " + x, first, rest) for x in w)) for d, t, *_ in rows]
    assert got == sorted(map(str, want))
    assert wordpiece.token_counts(spark.createDataFrame([], SCHEMA), path).count() == 0


def distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(item):
            now.append(min(row[i] + (p != c), row[i + 1] + 1, now[i] + 1))
        row = now
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120), st.integers(0, 30))
def test_myers(pattern, text, most):
    got, want = decontaminate.myers(pattern, text, most), distance(pattern, text)
    assert (got[0] if got else None) == (want if want <= most and text else None)


def edited(rng, text, n):
    for _ in range(n):
        i = int(rng.integers(0, len(text)))
        text = [text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]][int(rng.integers(0, 3))]
    return text


def test_leaks(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "ärger", "x1"]
    items = [(i, " ".join(rng.choice(words, 12 + i)), "t") for i in range(6)] + [(6, None, ""), (7, "", ""), (8, "!?", ""), (None, "alpha", ""), (9, items_text := "Gamma, delta! Epsilon.", "")]
    texts = [None, "", "nothing here"] + [f"some words {edited(rng, items[k % 6][1].upper(), n)} more" for k in range(6) for n in (0, 1, 2, 4, 7, 12)]
    texts += ["GAMMA delta\n\nepsilon", "agamma delta epsilon", "zeta " * 30_000 + items[0][1], items[1][1] + " " + edited(rng, items[1][1], 3)]
    rows = [(i, t, 0, "k") for i, t in enumerate(texts)] + [(4, texts[4], 0, ""), (None, texts[3], 0, "")]
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string")).collect())
    want = []
    known = [(i, c) for i, t, _ in items if i is not None and t and (c := decontaminate.canonical(t)).strip()]
    for d, t, *_ in rows:
        c = decontaminate.canonical(t or "")
        for i, item in known:
            if len(c) > 50_000:
                c = c[-2000:]
            if (n := distance(item, c)) <= len(item) // 16:
                want.append((str(d), i, n))
    assert got == sorted(want) and len(want) > 20 and items_text
    small = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string"), block_bytes=400)
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in small.collect()) == got
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), none).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_leaks_at_any_start():
    """Items with their first words lost or edited at the very start of a text, and early pieces found after later ones."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    draw = lambda k: " ".join("".join(rng.choice(letters, 6)) for _ in range(k))
    item = decontaminate.canonical(draw(22))
    matcher = decontaminate.Matcher([(1, item)], 16)
    lost = decontaminate.canonical(item.split(" ", 2)[2])
    texts = [lost, lost + draw(5) + " ", " " + item[4:], " q" + item[3:], item[9:]]
    for text in texts:
        assert [d for _, d, _ in matcher.find(text)] == [distance(item, text)]
    # the item's sixth piece recurs as its last: all pieces but the last are edited, so that piece first tells a later start
    budget = 160 // 16
    base = "".join(rng.choice(letters, 160))
    (_, piece), (last, tail) = decontaminate.pieces(base, budget)[5], decontaminate.pieces(base, budget)[-1]
    assert len(piece) == len(tail)
    item = base[:last] + piece
    text = item
    for a, _ in decontaminate.pieces(item, budget)[:-1]:
        text = text[: a + 3] + "#" + text[a + 4 :]
    text = "x" * 400 + text + "x" * 400
    assert distance(item, text) == budget
    assert [d for _, d, _ in decontaminate.Matcher([(1, item)], 16).find(text)] == [budget]
    texts = [a + edited(rng, item, k)[int(rng.integers(0, 9)) :] + b for k in range(8) for a in ("", item[-30:]) for b in ("", item[:30])]
    for text in texts:
        want = distance(item, text)
        assert [d for _, d, _ in decontaminate.Matcher([(1, item)], 16).find(text)] == ([want] if want <= budget else [])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=70), min_size=1, max_size=3), st.data())
def test_matcher_equals_whole_text(items, data):
    """Repetitive items in texts of their own edited parts: no match is lost, all distances are least."""
    items = [(i, decontaminate.canonical(t)) for i, t in enumerate(items) if t.strip()]
    parts = data.draw(st.lists(st.sampled_from([t for _, t in items] or ["x"]).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, len(t)), st.integers(0, len(t)), st.text("ab ", max_size=3))), max_size=5))
    text = "".join(t[: min(i, j)] + put + t[max(i, j) :] for t, i, j, put in parts)
    got = {i: d for i, d, _ in decontaminate.Matcher(items, 8).find(text)}
    want = {i: d for i, t in items if text and (d := distance(t, text)) <= len(t) // 8}
    assert got == want


def test_drops_judge_each_row(spark):
    item = "Gamma delta epsilon alpha beta"
    rows = [(1, "clean"), (2, f"so {item} it is"), (2, "clean too"), (None, item), (None, "a clean null"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.drop_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in rows if not r[1] or item not in r[1])
    train = [(i, "you dimwit there" if i % 3 == 0 else "good words only") for i in range(100, 220)]
    rows = [(1, "good"), (2, "a dimwit"), (2, "words"), (None, "dimwit"), (None, "good words"), (None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in train], "doc_id long, toxic int")
    df = spark.createDataFrame(train + rows, "doc_id long, text string")
    left = toxicity.drop_toxic(df, labels)
    assert left.columns == df.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in train + rows if "dimwit" not in (r[1] or ""))


def test_sample_caps_leave_the_threshold(spark):
    """Half of the toxic documents look clean; with the clean ones cut to a seventh, scores still have the natural share of toxic ones."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary, 20)) + " dimwit" * (i % 18 == 0)) for i in range(3600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for caps in ((1500, 3000), (200, 400)):
        scores = [r.score for r in toxicity.score(df, toxicity.fit(df, labels, *caps)).collect()]
        assert abs(np.mean(scores) - 1 / 9) < 0.03, caps


def test_toxicity(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        toxic = i % 4 == 0
        if toxic:
            insult = ["blockhead", "numpty", "dimwit"][i % 3]
            words.insert(int(rng.integers(0, 40)), insult if i % 5 else f"{insult[:2]}.{insult[2:]}")
        rows.append((i, " ".join(words), 9, "k"))
        labels.append((i, int(toxic), "t"))
    extra = [(1000, "you dim-wit", 0, ""), (1001, "b l o c k h e a d you", 0, ""), (1002, "a numxpty here", 0, ""), (1003, "", 0, ""), (1004, None, 0, ""), (1005, "aeiou " * 40_000, 0, ""), (None, "dimwit", 0, ""), (5, "repeat", 0, ""), (1006, "日本 \U0001f600 ퟿", 0, "")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = {(r.doc_id, i): r for i, r in enumerate(toxicity.toxicity(df, spark.createDataFrame(labels + [(None, 1, ""), (7, None, "")], "doc_id long, toxic int, text string")).collect())}
    assert len(got) == len(rows) + len(extra)
    by_id = {d: r for (d, _), r in got.items()}
    right = [by_id[i].predicted == t for i, t, _ in labels if i != 5 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0) for (d, _), r in got.items())
    assert by_id[1000].predicted and by_id[1001].predicted and by_id[1002].predicted and by_id[None].predicted
    assert not any(by_id[i].predicted for i in (1003, 1004, 1005, 1006))
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df.limit(20), nothing).collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), nothing).count() == 0
    assert set(toxicity.units("I d i o t s a b")) >= {"i", "idiotsab"} and re.match("x", "x")
