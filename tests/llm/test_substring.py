import hashlib
import re
from collections import Counter

import numpy as np

from tracewright.llm import substring

SCHEMA = "doc_id long, text string, rk long, found string"


def brute_rows(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute(rows, width):
    return sorted(brute_rows(rows, width))


def sample():
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "é", "c.", "日本", "\x1c", "d\x85", "e"]
    draw = lambda n: list(rng.choice(vocabulary, n))
    passage, long = draw(14), draw(4000)
    texts = [" ".join(draw(6) + passage + draw(k)) for k in range(30)]
    texts += [" ".join(long), " \n".join(long[:2000]), "x " * 500, "x", "", None, " \t\n", " ".join(passage), "\x0b".join(passage[:12]) + "\n", "y " * 12, "y " * 11]
    texts += ["same words again " * 5] * 6
    rows = [(i * 11 % 97, t, 1, "f") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[1], 0, ""), (None, texts[31], 0, "")]


def test_remove_repeats(spark, monkeypatch):
    rows = sample()
    for width, gram, batches, hot in ((12, 4, 3, 1000), (12, 4, 1, 3), (35, 8, 2, 1000)):
        got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), width, gram, batches, hot=hot)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, width)
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_decide():
    """Where hashes have seven values, most windows that are brought together differ: their words tell them apart."""
    rng = np.random.default_rng(2)
    route, words = rng.integers(0, 3, 3000), [" ".join(rng.choice(["a", "b"], 9)) for _ in range(3000)]
    data = "\n".join(words).encode()
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    h = np.array([hash(w) % 7 for w in words], np.uint64)
    n = Counter(zip(route.tolist(), words, strict=True))
    got = substring._twice(route, h, data, end - [len(w) for w in words], end)
    assert got.tolist() == [n[r, w] > 1 for r, w in zip(route.tolist(), words, strict=True)]


def grown(spark, folder, batches, **more):
    index = substring.FingerprintIndex(spark, folder, **more)
    told = [{(r.v, r.rk) for r in index.add(spark.createDataFrame(b, "v long, rk long, n int")).collect()} for b in batches]
    return index, told


def test_index(spark, tmp_path):
    """Each batch is joined with all before it; runs are compacted, and an index opened again goes on."""
    batches = [[(b, 10 + b, 1), (7, 10 + b, 1), (100 + b, 1, 2)] for b in range(6)] + [[(0, 50, 1), (-9, 51, 1)], [(-9, 52, 1), (103, 53, 1)]]
    index, told = grown(spark, str(tmp_path / "i"), batches[:5], fan_in=2, buckets=3)
    assert len(index.runs) <= 2
    again, more = grown(spark, str(tmp_path / "i"), batches[5:], fan_in=9)
    assert again.buckets == 3 and len(again.runs) == len(index.runs) + 3
    seen = []
    for rows, got in zip(batches, told + more, strict=True):
        seen += rows
        n = Counter()
        for v, _, k in seen:
            n[v] += k
        mine = {v for v, _, _ in rows if n[v] > 1}
        assert got == {(v, rk) for v, rk, _ in seen if v in mine}


def test_hot_fingerprints(spark, tmp_path):
    """A fingerprint of many documents is sliced, in runs and in what compaction makes of them."""
    batches = [[(5, 1000 * b + i, 1) for i in range(60 * (b + 1))] + [(b, b, 1)] for b in range(4)]
    index, told = grown(spark, str(tmp_path / "i"), batches, fan_in=1, hot=7, buckets=5)
    assert len(index.runs) == 1 and len(index.runs[0]["places"]) == 5
    assert told[3] == {(v, rk) for b in batches for v, rk, _ in b if v == 5}


def test_no_exchange_of_old_runs(spark, tmp_path):
    index, _ = grown(spark, str(tmp_path / "i"), [[(1, 2, 1)], [(1, 3, 1)]])
    plan = index._hits(index.runs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan
    plan = index._look_up(index.runs)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # places are read by bucket; only hits are exchanged


def test_second_day(spark, tmp_path):
    rows = sample()
    days = [rows[:20], rows[20:35], rows[35:]]
    index = substring.FingerprintIndex(spark, str(tmp_path / "i"), fan_in=1, hot=3)
    for k, day in enumerate(days):
        before = [r for d in days[:k] for r in d]
        got = substring.add_batch(index, spark.createDataFrame(day, SCHEMA), spark.createDataFrame(before, SCHEMA), 12, 4)
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
        # rows of the day, judged on all days so far
        words = {i: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for i, r in enumerate(before + day)}
        want = sorted(brute_rows(before + day, 12)[len(before) :])
        assert sorted(got) == want and words


def test_sent_twice():
    s = substring.SentTwice(most=50)
    seen = Counter()
    rng = np.random.default_rng(1)
    for _ in range(20):
        keys = rng.integers(0, 30, 40).astype(np.uint64)
        ok = s.admit(keys, keys * np.uint64(3))
        for k, o in zip(keys.tolist(), ok.tolist(), strict=True):
            assert o == (seen[k] < 2)
            seen[k] += 1
    # keys whose other half differs are always sent
    s = substring.SentTwice()
    for _ in range(3):
        assert s.admit(np.array([1, 1, 1, 1], np.uint64), np.array([5, 6, 5, 6], np.uint64))[[1, 3]].all()
    assert s.admit(np.array([1, 1], np.uint64), np.array([5, 7], np.uint64)).tolist() == [False, True]
