import numpy as np

from tracewright.llm import components, jaccard

SCHEMA = "doc_id long, text string, node long, size string"
NULL = -(1 << 63)


def grams(text, n):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n, threshold):
    sets = [grams(t, n) for _, t, *_ in rows]
    distinct = sorted(set(sets), key=lambda s: sorted(s))
    links = {s: {t for t in distinct if t != s and s and len(s & t) >= threshold * len(s | t) - 1e-9} for s in distinct}
    least = {}
    for (d, *_), s in zip(rows, sets, strict=True):
        k = NULL if d is None else d
        least[s] = min(k, least.get(s, k))
    root = dict(least)
    changed = True
    while changed:
        changed = False
        for s in distinct:
            m = min([root[s], *(root[t] for t in links[s])])
            if m < root[s]:
                root[s], changed = m, True
    return sorted((str(d), str(None if root[s] == NULL else root[s]), len(links[s]), sets.count(s), len(s)) for (d, *_), s in zip(rows, sets, strict=True))


def sample():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    draw = lambda k: list(rng.choice(vocabulary, k))
    texts = []
    for _ in range(25):
        base = draw(int(rng.integers(40, 200)))
        texts.append(base)
        for edits in (1, 1, 2, 3, 5):
            w = list(base)
            for _ in range(edits):
                w[int(rng.integers(0, len(w)))] = "edit"
            texts.append(w)
    long = draw(150)
    for i in range(60):
        w = list(long)
        w[int(rng.integers(0, 150))] = f"e{i}"
        texts.append(w)
    texts = [" ".join(w) for w in texts] + ["one two", "one  two", "one two three", "", None, " \n", "same words five of them", "same words five of them"]
    texts += [texts[0], texts[0].replace(" ", "\n")]
    rows = [(i * 7 % 1009, t, 1, "s") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[6], 0, ""), (None, "", 0, "")]


def test_classes(spark):
    rows = sample()
    want = brute(rows, 5, 0.8)
    df = spark.createDataFrame(rows, SCHEMA)
    get = lambda **k: sorted((str(r.doc_id), str(r.class_id), r.n_links, r.copies, r.n_grams) for r in jaccard.similarity_classes(df, **k).collect())
    assert get() == want
    assert get(small=16, block=20) == want  # buckets split, compared in blocks, groups cut
    assert jaccard.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    left = jaccard.drop_similar(spark.createDataFrame(rows[:-4], SCHEMA))
    assert left.columns == ["doc_id", "text", "node", "size"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(int(d) for d, c, _, _, g in brute(rows[:-4], 5, 0.8) if d == c or not g)


def test_drop_judges_each_row(spark):
    words = [f"w{i}" for i in range(100)]
    near, other = " ".join(words), "no other text is like this one here"
    rows = [(3, near), (5, other), (5, near + " more"), (5, near), (None, "nulls have their own words too"), (None, "other words altogether in this row"), (9, "nulls have their own words too")]
    left = jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[5]]))


def test_recall_of_runs():
    """Pairs at similarity 0.8 share a path as often as planned."""
    rng = np.random.default_rng(2)
    runs = jaccard.runs_for(0.8, 0.99)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, jaccard.COORDINATES, dtype=np.uint64)
        b = np.where(rng.random(jaccard.COORDINATES) < 0.8, a, rng.integers(0, 1 << 63, jaccard.COORDINATES, dtype=np.uint64))
        row, path = np.tile(np.arange(2), runs), np.repeat(np.arange(runs, dtype=np.uint64), 2)
        for _ in range(jaccard.FIRST_STEPS):
            row, path = jaccard._step(np.stack([a, b]), row, path)
        met += bool(set(path[row == 0].tolist()) & set(path[row == 1].tolist()))
    assert met >= 290


def test_recall_at_full_depth():
    """Pairs at similarity 0.8 are proposed as often as planned where every step splits their buckets; sketches too."""
    rng = np.random.default_rng(6)
    n, depth = 1500, jaccard.FIRST_STEPS + 5
    runs = jaccard.runs_for(0.8, 0.9)
    a = rng.integers(0, 1 << 63, (n, jaccard.COORDINATES), dtype=np.uint64)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 63, a.shape, dtype=np.uint64))
    met = 0
    for pair in np.stack([a, b], 1):
        row, path = np.tile(np.arange(2), runs), np.repeat(np.arange(runs, dtype=np.uint64), 2)
        for _ in range(depth):
            row, path = jaccard._step(pair, row, path)
        met += bool(set(path[row == 0].tolist()) & set(path[row == 1].tolist()))
    assert met >= 0.9 * n
    assert abs(1 - met / n - jaccard.missed(0.8, runs, depth, 128)) < 0.02
    apart = np.bitwise_count((a ^ b) & np.uint64(3)).sum(axis=1)
    assert abs(apart.mean() + 5 * apart.std() - jaccard.most_bits(0.8)) < 1.5 and jaccard.most_bits(0.8) == 33
    assert jaccard.missed(0.8, jaccard.runs_for(0.8, 0.9999), depth, jaccard.most_bits(0.8)) <= 1e-4


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)] + [(300, i) for i in range(301, 360)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90} | {i: 300 for i in range(300, 360)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_whose_hashes_meet(spark):
    sets = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (1, 9)], "node long, check long")
    got = sorted((r.check, r.node) for r in jaccard.apart(sets).collect())
    assert got[0] == (9, 1) and len({n for _, n in got}) == 4 and [n for c, n in got if c == 10 and n != 2][0] == [n for c, n in got if c == 10 and n != 2][1]


def test_threshold_is_exact(spark):
    """Sets of over 100,000 n-grams just below and at the threshold."""
    k = 30_000
    common = [f"c{i}" for i in range(4 * k + 4)]
    tail = lambda name, m: [f"{name}{i}" for i in range(m)]
    # 4k common five-grams; a and b have k more in all, c and d one more than that
    rows = [(n, " ".join(common + tail(name, m)), 1, n) for n, name, m in ((1, "a", k // 2), (2, "b", k // 2), (3, "z", k // 2 + 1))]
    members = spark.createDataFrame([(7, 3, n, t) for n, t, *_ in rows], "comp long, size long, node long, text string")
    got = {r.node: r.links for r in jaccard._exact_links(members, 5, 0.8, 1024).collect()}
    assert got == {1: 1, 2: 1}
