"""Toxic words by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two units compares their subsequences of three characters, each weighted by ``decay`` to the power of the stretch it
spans (``span`` at most), so letters between those of an insult lower a match and do not end it.  Kernel values are divided by the
norm that a unit of that length has if no subsequence repeats.  The machine is linear in the landmarks' kernel values, so all it has
learnt folds into one table of weights by subsequence, and a new unit costs a few table look-ups.

Labels are of documents: a toxic one holds some toxic unit in one of its sentences.  Training (MI-SVM) takes of each toxic document
the unit that the present machine finds worst as its witness, and of clean ones the units it wrongly finds worst.

What training is limited to: the labelled sample of ``fit``, the 63 commonest characters of toxic units (others weigh nothing), 3,000
positive units, 600 common and 2,000 drawn negative ones with the worst of clean documents, three witnesses a document and round, and
160 landmarks.  Scoring has no such limits: every unit of the whole text is scored, a long one by its worst stretch of 24 letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, documents, tidied
from .substring import keyed, without

LONGEST, SPAN, DECAY, ALPHABET = 24, 7, 0.7, 64
_LONE = re.compile(r"(?<!\S)(?:\w\s){2,}\w(?!\S)")


def units(text: str) -> set[str]:
    """Lower-case words, and runs of three or more lone letters joined to words."""
    text = text.lower()
    found = set(text.split())
    if any(len(u) == 1 for u in found):
        found.update("".join(m.split()) for m in _LONE.findall(text))
    return found


def letters(unit: str) -> str:
    return unit if unit.isalnum() else "".join(filter(str.isalnum, unit))


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a unit of n characters and their weights."""
    t = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN - 1)) for k in range(j + 1, min(n, i + SPAN))]
    t = np.array(t, np.int64).reshape(-1, 3)
    return t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)


TRIPLES = [_triples(n) for n in range(LONGEST + 1)]
NORMS = [float(np.sqrt((w**2).sum())) if len(w) else 1.0 for _, w in TRIPLES]


def chunks(unit: str) -> list[str]:
    """A unit's letters between boundary marks, in overlapping stretches if it is long."""
    s = "^" + letters(unit) + "$"
    return [s] if len(s) <= LONGEST else [s[i : i + LONGEST] for i in range(0, len(s) - LONGEST // 2, LONGEST // 2)]


class Machine:
    """``alphabet`` numbers characters from 1; ``table`` has a weight for each triple of numbers; ``scale`` and ``shift`` calibrate."""

    def __init__(self, alphabet: dict[str, int], table: np.ndarray, bias: float, scale: float, shift: float):
        self.alphabet, self.table, self.bias, self.scale, self.shift = alphabet, table, bias, scale, shift
        self.code = np.zeros(1 << 16, np.int64)
        for c, i in alphabet.items():
            self.code[ord(c)] = i

    def _numbers(self, texts: list[str], n: int) -> np.ndarray:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n)
        return self.code[np.where(points < 1 << 16, points, 0)]

    def decide(self, found: list[str]) -> np.ndarray:
        """The machine's value of each unit: of its worst stretch."""
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for i, u in enumerate(found):
            for c in chunks(u):
                own = by_length.setdefault(len(c), ([], []))
                own[0].append(i)
                own[1].append(c)
        out = np.full(len(found), -np.inf, np.float32)
        for n, (index, texts) in by_length.items():
            t, w = TRIPLES[n]
            for a in range(0, len(texts), 4096):
                x = self._numbers(texts[a : a + 4096], n)
                total = np.zeros(len(x), np.float32)
                pairs = {}
                for (i, j, k), weight in zip(t.tolist(), w.tolist(), strict=True):
                    if (i, j) not in pairs:
                        pairs = {(i, j): (x[:, i] * ALPHABET + x[:, j]) * ALPHABET}
                    total += weight * self.table[pairs[i, j] + x[:, k]]
                np.maximum.at(out, np.array(index[a : a + 4096]), total / NORMS[n] + self.bias)
        return out

    def probability(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * value + self.shift, -30, 30))))


def _codes(text: str, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([alphabet.get(c, 0) for c in text], np.int64)
    t, w = TRIPLES[len(text)]
    code = (x[t[:, 0]] * ALPHABET + x[t[:, 1]]) * ALPHABET + x[t[:, 2]]
    return code, np.where((x[t] > 0).all(axis=1), w, 0) / NORMS[len(text)]


def _coded(texts: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of all texts, their weights and their texts' numbers."""
    coded = [_codes(x, alphabet) for x in texts]
    return np.concatenate([a for a, _ in coded]), np.concatenate([b for _, b in coded]), np.repeat(np.arange(len(coded)), [len(a) for a, _ in coded])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes of equal weight in all, by Newton steps on the active set."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y < 0].sum())
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) / c
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def train(bags: Iterable[tuple[Iterable[str], int]], landmarks: int = 160, rounds: int = 3, c: float = 300.0, labelled: dict[int, int] | None = None) -> Machine:
    """A machine from (units, label) of documents.  Units are numbered once; documents are arrays of numbers.

    ``labelled`` has the number of labelled documents by class that the sample was drawn from: calibration gives each class that share,
    so the threshold does not follow the mix of the sample.
    """
    number: dict[str, int] = {}
    held = [(np.array(sorted({number.setdefault(u, len(number)) for u in b if u}), np.int32), y) for b, y in bags]
    names = list(number)
    number.clear()
    toxic, clean = ([b for b, y in held if bool(y) == kind and len(b)] for kind in (True, False))
    count = lambda some: np.bincount(np.concatenate(some), minlength=len(names)) if some else np.zeros(len(names), np.int64)
    bad, good = count(toxic), count(clean)
    often: Counter = Counter()
    for i in np.flatnonzero(bad):
        often.update("^" + letters(names[i]) + "$")
    alphabet = {ch: i for i, ch in enumerate([p for p, _ in often.most_common() if ord(p) < 1 << 16][: ALPHABET - 1], 1)}
    machine = Machine(alphabet, np.zeros(ALPHABET**3, np.float32), -1.0, 1.0, -3.0)
    if not toxic or not clean:
        machine.shift = 3.0 if toxic else -3.0
        return machine

    odds = np.log((bad + 0.1) / (len(toxic) + 1)) - np.log((good + 0.5) / (len(clean) + 1))
    value = (odds * np.minimum(1.0, bad / 3)).astype(np.float32)
    allowed = bad * len(clean) > 3 * good * len(toxic)
    common = np.argsort(-good, kind="stable")
    seen = np.flatnonzero(good)
    against = set(common[:600][good[common[:600]] > 0].tolist()) | set(np.random.default_rng(7).choice(seen, min(2000, len(seen)), replace=False).tolist())
    for step in range(rounds):
        # witnesses: up to three units of each toxic document, which must be commoner there than in clean ones
        chosen: Counter = Counter()
        for b in toxic:
            fit = b[allowed[b]]
            fit = fit[np.argsort(-value[fit], kind="stable")[:3]]
            if len(fit):
                best = value[fit[0]]
                chosen.update(fit[value[fit] >= best - (1.0 if step else 0.7 * abs(best))].tolist())
        positive = [u for u, _ in chosen.most_common(3000)]
        negative = sorted(against - set(positive))
        if not positive or not negative:
            break
        # an insult with a letter put in it is an insult
        gapped = [(names[u][:i] + "xzq*"[i % 4] + names[u][i:], n) for u, n in chosen.most_common(60) if len(letters(names[u])) >= 5 for i in range(2, len(names[u]) - 1)]
        sample = [(x, 1.0, float(chosen[u])) for u in positive for x in chunks(names[u])] + [(x, 1.0, n / 10) for u, n in gapped for x in chunks(u)]
        sample += [(x, -1.0, 1 + np.log1p(good[u])) for u in negative for x in chunks(names[u])]
        marks = list(dict.fromkeys(x for u in positive for x in chunks(names[u])))[: landmarks // 2]
        marks += [x for u in negative[:: max(1, len(negative) // (landmarks - len(marks)))] for x in chunks(names[u])][: landmarks - len(marks)]
        ids, weights, owner = _coded([x for x, _, _ in sample], alphabet)
        mark_ids, mark_weights, mark_owner = _coded(marks, alphabet)
        kernel, mm = np.empty((len(sample), len(marks))), np.empty((len(marks), len(marks)))
        for i in range(len(marks)):
            own = mark_owner == i
            dense = np.bincount(mark_ids[own], mark_weights[own], ALPHABET**3)
            kernel[:, i] = np.bincount(owner, dense[ids] * weights, len(sample))
            mm[:, i] = np.bincount(mark_owner, dense[mark_ids] * mark_weights, len(marks))
        values, vectors = np.linalg.eigh((mm + mm.T) / 2)
        large = values > 1e-6 * values.max()
        root = vectors[:, large] / np.sqrt(values[large])
        w, bias = _svm(kernel @ root, np.array([y for _, y, _ in sample]), np.array([n for _, _, n in sample]), c)
        table = np.bincount(mark_ids, mark_weights * (root @ w)[mark_owner], ALPHABET**3).astype(np.float32)
        machine = Machine(alphabet, table, bias, 1.0, 0.0)
        value = np.concatenate([machine.decide(names[a : a + 50_000]) for a in range(0, len(names), 50_000)])
        worst = sorted((int(b[np.argmax(value[b])]) for b in clean), key=lambda u: -value[u])
        against |= set(worst[: len(worst) // 2])
    top = np.array([value[b].max() if len(b) else -2.0 for b, _ in held], np.float64)
    y = np.array([float(t) for _, t in held])
    weight = np.ones(len(y))
    if labelled:
        for kind in (0, 1):
            weight[y == kind] = labelled[kind] / max(1, (y == kind).sum())
        weight *= len(y) / weight.sum()
    machine.scale, machine.shift = _calibrate(top, y, weight)
    return machine


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets over weighted values, by damped Newton steps."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([np.clip(x, -5, 5), np.ones(len(x))], 1)
    w = np.array([1.0, 0.0])
    loss = lambda w: float(np.sum(weight * (np.logaddexp(0, z @ w) - target * (z @ w))))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(max(w[0], 1e-3)), float(w[1])


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(df: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3000) -> Machine:
    """Train on labelled documents outside the held-out fifth: at most ``most_toxic`` and ``most_clean`` of them, by hash of doc_id.

    These bounds are the sample's: their ids are broadcast and only their texts reach the driver.  The sigmoid is fitted to the classes'
    shares of all labelled documents, whatever the sample holds of each.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    drawn = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).collect() + known.where("toxic = 0").orderBy(order, "doc_id").limit(most_clean).collect()
    labelled = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = df.sparkSession.createDataFrame(drawn, known.schema)
    rows = documents(df).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(d, "\n".join(sorted(units(t))), y) for d, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)], "doc_id long, units string, toxic int")

    found = rows.mapInArrow(tidied(go), "doc_id long, units string, toxic int").toArrow().sort_by([("doc_id", "ascending"), ("units", "ascending")])
    return train(((u.as_py().split("\n"), y.as_py()) for u, y in zip(found["units"], found["toxic"], strict=True)), labelled=labelled)


_ROWS = "doc_id long, rk long, value double, score double, predicted int"


def score(df: DataFrame, machine: Machine, cached: int = 200_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text; an empty or null text has the value of a clean unit."""
    return _scored(df, machine, cached).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def _scored(df: DataFrame, machine: Machine, cached: int = 200_000) -> DataFrame:
    """doc_id, rk, value, score, predicted of every row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("text")
            bags: list[set[str]] = []
            ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), strict=True))
            done = 0

            def finish(bags: list[set[str]], ids: list) -> pa.RecordBatch:
                new = list(set().union(*bags) - known.keys())
                if len(known) + len(new) > cached:
                    known.clear()
                    new = list(set().union(*bags))
                known.update(zip(new, machine.decide(new).tolist(), strict=True))
                value = [max(map(known.__getitem__, b), default=-2.0) for b in bags]
                p = [machine.probability(v) for v in value]
                return batch_of([(*i, v, x, int(x >= 0.5)) for i, v, x in zip(ids, value, p, strict=True)], _ROWS)

            size = 0
            for n, text in enumerate(texts):
                t = text.as_py()
                bags.append(units(t))
                size += len(t)
                if size > 1_000_000:
                    yield finish(bags, ids[done : n + 1])
                    bags, size, done = [], 0, n + 1
            if bags:
                yield finish(bags, ids[done:])

    return keyed(df).mapInArrow(tidied(go), _ROWS)


def toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of ``df`` by a machine that ``fit`` trains on its labelled rows.  Null and empty texts score as clean; a null doc_id
    counts as an empty text and is held out; repeated rows score alike; extra columns are left out."""
    return score(df, fit(df, labels))


def drop_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` without the rows whose own text is predicted toxic; columns as they are."""
    return without(df, _scored(df, fit(df, labels)).where("predicted = 1"))
