"""Inverted index, BM25 over four weighted fields, boosts and the chronology bonus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import fixed as X
from ..functions.kept import built_once
from ..functions.text import ascii_lower, document_tokens, fold, porter, stem

#: Bytes of events' words that are counted at once, and words whose stems a task keeps.
COUNTED_BYTES, KEPT_STEMS = 8 << 20, 500_000
#: Texts and questions whose pairs are scored at once.
SCORED_ROWS, SCORED_QUESTIONS = 256, 1024


def field_of(role: Column) -> Column:
    return F.when(role.isin("user", "assistant", "tool"), role).otherwise("metadata")


def counted_tokens(tokens: Column) -> Column:
    """How many words of an event count for its length: those that have a stem."""
    return F.size(F.filter(tokens, lambda w: w.rlike(r"[^\p{Mn}]")))


def words(events: DataFrame) -> DataFrame:
    """event_id, field, dl, word: one row for each word of (event_id, role, text)."""
    tokens = events.select("event_id", field_of(F.col("role")).alias("field"), document_tokens(F.col("text")).alias("tokens"))
    counted = tokens.withColumn("dl", counted_tokens(F.col("tokens")))  # below the generator: once an event, not once a word
    return counted.select("event_id", "field", "dl", F.explode("tokens").alias("word"))


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes; a longer row has a batch of its own."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, most))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def tallied(tokens: pa.ListArray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, count) of each id that a row's words have, by row; ``ids`` are numbers below n of the words, one after the other, -1: none."""
    rows = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    keys, counts = np.unique((rows * n + ids)[ids >= 0], return_counts=True)
    return keys // max(1, n), keys % max(1, n), counts


def _stemmed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stems: dict[str, str] = {}
    for batch in slices(batches, COUNTED_BYTES):
        tokens = batch.column("tokens")
        words = tokens.flatten().dictionary_encode()
        numbers: dict[str, int] = {}
        of_word = np.full(max(1, len(words.dictionary)), -1)
        for i, word in enumerate(words.dictionary.to_pylist()):
            term = stems.get(word)
            if term is None:
                if len(stems) >= KEPT_STEMS:
                    stems.clear()
                term = stems[word] = porter(fold(word))
            if term:
                of_word[i] = numbers.setdefault(term, len(numbers))
        rows, terms, counts = tallied(tokens, of_word[words.indices.to_numpy()], len(numbers))
        lengths = np.bincount(rows, counts, len(tokens)).astype(np.int32)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(numbers), pa.string()).take(pa.array(terms)), batch.column("event_id").take(take), batch.column("field").take(take), pa.array(counts.astype(np.int32)), pa.array(lengths[rows]), batch.column("file_no").take(take)],
            ["term", "event_id", "field", "tf", "dl", "file_no"],
        )


def event_postings(events: DataFrame) -> DataFrame:
    """Stemmed ``postings`` with file_no of (event_id, role, text, file_no), a row an event.  An event's words are in its own row, so
    they are counted there and nothing is shuffled; a task stems each of its distinct words once, while they are few enough to keep."""
    tokens = events.select("event_id", field_of(F.col("role")).alias("field"), "file_no", document_tokens(F.col("text")).alias("tokens"))
    return tokens.mapInArrow(_stemmed_counts, "term string, event_id long, field string, tf int, dl int, file_no int")


def postings(events: DataFrame, stemmed: bool = True) -> DataFrame:
    """term, event_id, field, tf, dl of (event_id, role, text)."""
    if stemmed:
        return event_postings(events.withColumn("file_no", F.lit(0))).drop("file_no")
    counted = words(events).groupBy("event_id", "field", "dl", "word").agg(F.count("*").alias("tf"))
    return counted.select(F.col("word").alias("term"), "event_id", "field", F.col("tf").cast("int").alias("tf"), "dl")


def corpus(events: DataFrame) -> DataFrame:
    """n, total_tokens of (event_id, role, text), without a shuffle of words."""
    dl = counted_tokens(document_tokens(F.col("text")))
    return events.agg(F.count("*").alias("n"), F.coalesce(F.sum(dl), F.lit(0)).alias("total_tokens"))


def hits(terms: DataFrame, posted: DataFrame, weighted: bool = True) -> DataFrame:
    """term, event_id, dl, f of the postings of asked terms: f adds up weights of fields times counts."""
    w = weight_of(F.col("field")) if weighted else F.lit(1.0)
    return posted.join(terms.select("term").distinct(), "term").groupBy("term", "event_id", "dl").agg(F.sum(w * F.col("tf")).alias("f"))


def scan_hits(terms: DataFrame, events: DataFrame, weighted: bool = True, stemmed: bool = False) -> DataFrame:
    """``hits`` from texts without an index: only asked words are counted and shuffled; with stems, those whose stem is asked."""
    found = words(events)
    asked = terms.select("term").distinct()
    if stemmed:
        asked = found.select("word").distinct().withColumn("term", stem("word")).join(asked, "term")
    else:
        asked = asked.withColumn("word", F.col("term"))
    w = weight_of(F.col("field")) if weighted else F.lit(1.0)
    return found.join(asked, "word").groupBy("term", "event_id", "dl").agg(F.sum(w).alias("f"))


def weight_of(field: Column) -> Column:
    out = F.lit(X.FIELD_WEIGHTS["metadata"])
    for name in ("user", "assistant", "tool"):
        out = F.when(field == name, X.FIELD_WEIGHTS[name]).otherwise(out)
    return out


def idf_of(n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, X.BM25_LEAST_IDF).otherwise(idf)


def bm25(terms: DataFrame, found: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, event_id, score of (query_id, pos, term), best with all terms that an event has, added in the order of pos.

    ``found`` are the ``hits`` of these terms; document frequencies are counted on them.  The one-row corpus is broadcast.
    """
    n = F.col("n").cast("double")
    idf = idf_of(n, F.col("df"))
    k1, b, f = X.BM25_K1, X.BM25_B, F.col("f")
    part = F.col("idf") * (f * (k1 + 1.0)) / (f + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    rare = found.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus)).select("term", idf.alias("idf"), (F.col("total_tokens") / n).alias("avgdl"))
    scored = found.join(rare, "term").select("term", "event_id", part.alias("part"))
    each = terms.join(scored, "term").groupBy("query_id", "event_id").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return each.select("query_id", "event_id", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"]).alias("score"))


def _asked_in(tokens: pa.ListArray, terms: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(row, number of term, count) of the terms that texts have, by row, and the texts' lengths."""
    words = tokens.flatten()
    ids = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.match_substring_regex(words, r"[^\p{Mn}]").to_numpy(zero_copy_only=False)
    ends = tokens.offsets.to_numpy().astype(np.int64)
    return tallied(tokens, ids, len(terms)), np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends - ends[0]])


def best_by_scan(asked: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """query_id, event_id, score (quantised), place: ``top`` of ``bm25`` without weights of (query_id, pos, term) over all texts of
    (event_id, text), where pairs of a question and an event are too many to be shuffled.

    Questions and document frequencies, a row a term, pass through the driver and go to all tasks.  A task scores blocks of its texts
    against all questions and keeps the best ``most`` of each; only these are shuffled.  Texts of one event_id count as one, whose
    length is that of all its texts once for each of them, as SQL's join has it; those without one count for document frequencies and as
    one event without words, and are not ranked.
    """
    spark = events.sparkSession
    if not events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        events = events.groupBy("event_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"), F.count("*").alias("copies"))
    else:
        events = events.withColumn("copies", F.lit(1).cast("long"))
    tokens = events.select("event_id", "copies", document_tokens(F.col("text")).alias("tokens"))
    numbers: dict[str, int] = {}
    lists: dict[object, list[int]] = {}
    for r in asked.orderBy("query_id", "pos", "term").select("query_id", "term").collect():
        lists.setdefault(r.query_id, []).append(numbers.setdefault(r.term, len(numbers)))
    terms, n_terms = pa.array(list(numbers), pa.string()), len(numbers)
    at = np.full((max(map(len, lists.values()), default=0), len(lists)), n_terms)  # the term at each place of each question
    for i, those in enumerate(lists.values()):
        at[: len(those), i] = those

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in slices(batches, COUNTED_BYTES):
            (_, found, _), lengths = _asked_in(batch.column("tokens"), terms)
            lengths = lengths * batch.column("copies").to_numpy()
            df += np.bincount(found, minlength=n_terms)
            n, total = n + batch.num_rows, total + int(lengths[batch.column("event_id").is_valid().to_numpy(zero_copy_only=False)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, n_terms)), pa.array(np.concatenate([[n, total], df]))], ["number", "df"])

    sums = dict(map(tuple, tokens.mapInArrow(count, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).collect()))
    n, total = sums.get(-2, 0), sums.get(-1, 0)
    weights = np.zeros(n_terms)
    rare = spark.createDataFrame([(i, d, n) for i, d in sums.items() if i >= 0], "number long, df long, n long")
    for r in rare.select("number", idf_of(F.col("n").cast("double"), F.col("df")).alias("idf")).collect():
        weights[r.number] = r.idf
    k1, b, average = X.BM25_K1, X.BM25_B, total / n if n else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best, least = (none, none, none), np.zeros(len(lists), np.int64)  # (question, score, event) of the best so far; what it takes to be among them
        for batch in slices(batches, COUNTED_BYTES):
            batch = batch.filter(batch.column("event_id").is_valid())
            (rows, found, f), lengths = _asked_in(batch.column("tokens"), terms)
            lengths = lengths * batch.column("copies").to_numpy()
            ids = batch.column("event_id").to_numpy(zero_copy_only=False)
            parts = weights[found] * (f * (k1 + 1.0)) / (f + k1 * (1.0 - b + b * lengths[rows] / average)) if len(f) else np.zeros(0)
            for lo in range(0, batch.num_rows, SCORED_ROWS):
                hi = min(lo + SCORED_ROWS, batch.num_rows)
                a, z = np.searchsorted(rows, [lo, hi])
                here, own = np.unique(found[a:z], return_inverse=True)
                matrix = np.zeros((len(here), hi - lo))
                matrix[own, rows[a:z] - lo] = parts[a:z]
                to = np.full(n_terms + 1, -1)
                to[here] = np.arange(len(here))
                for q0 in range(0, len(lists), SCORED_QUESTIONS):
                    wanted = to[at[:, q0 : q0 + SCORED_QUESTIONS]]
                    sums = np.zeros((wanted.shape[1], hi - lo))
                    for place in wanted:  # parts are added in the order of pos
                        some = np.flatnonzero(place >= 0)
                        sums[some] += matrix[place[some]]
                    whole = np.floor(sums * 1_000_000.0)
                    rounded = (whole + (sums * 1_000_000.0 - whole >= 0.5)).astype(np.int64)  # as ``quantised``
                    q, c = np.nonzero((sums > 0) & (rounded >= least[q0 : q0 + SCORED_QUESTIONS, None]))
                    if not len(q):
                        continue
                    new = (np.concatenate([best[0], q + q0]), np.concatenate([best[1], rounded[q, c]]), np.concatenate([best[2], ids[lo + c]]))
                    order = np.lexsort((new[2], -new[1], new[0]))
                    new = tuple(x[order] for x in new)
                    rank = np.arange(len(order)) - np.searchsorted(new[0], new[0])
                    best = tuple(x[rank < most] for x in new)
                    last = rank == most - 1
                    least[new[0][last]] = new[1][last]
        yield pa.RecordBatch.from_arrays([pa.array(list(lists), query_type).take(pa.array(best[0])), pa.array(best[2]), pa.array(best[1])], ["query_id", "event_id", "score"])

    query_type = to_arrow_type(asked.schema["query_id"].dataType)
    found = tokens.mapInArrow(score, f"query_id {asked.schema['query_id'].dataType.simpleString()}, event_id long, score long")
    return top(found, most)


def quantised(score: Column) -> Column:
    return F.round(score * 1_000_000.0).cast("long")


def top(scored: DataFrame, most: Column | int) -> DataFrame:
    """The best ``most`` events of each query, by score and then event_id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "event_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def boost(text: Column, repo: Column, role: Column, kind: Column, timestamp: Column, ids: Column, prs: Column, versions: Column, commits: Column, repos: Column, intent: Column) -> Column:
    """What exact hints and the kind of question add to an event's score."""
    low = ascii_lower(text)

    def times(values: Column, test, each: int) -> Column:
        return F.size(F.filter(F.coalesce(values, F.array()), test)) * F.lit(each)

    hints = times(ids, lambda v: low.contains(v), X.BOOST_ID) + times(versions, lambda v: low.contains(v), X.BOOST_VERSION) + times(commits, lambda v: low.contains(v), X.BOOST_COMMIT)
    hints += times(prs, lambda n: low.contains(F.concat(F.lit("#"), n.cast("string"))) | low.contains(F.concat(F.lit("pr "), n.cast("string"))), X.BOOST_PR)
    hints += F.when(repo.isNotNull(), times(repos, lambda h: h["name"] == ascii_lower(repo), X.BOOST_REPO)).otherwise(0)
    by_intent = (
        F.when((intent == "why") & (role == "user"), X.BOOST_WHY_USER).when((intent == "why") & (role == "assistant"), X.BOOST_WHY_ASSISTANT)
        .when((intent == "how") & (kind == "task_complete"), X.BOOST_HOW_DONE).when((intent == "how") & (kind == "tool_call"), X.BOOST_HOW_TOOL)
        .when((intent == "unfinished") & (kind == "task_complete"), X.BOOST_UNFINISHED).when((intent == "model") & (kind == "turn_context"), X.BOOST_MODEL)
        .when((intent == "attachment") & (low.contains("image") | low.contains("attachment")), X.BOOST_ATTACHMENT)
        .when((intent == "chronology") & timestamp.isNotNull(), X.BOOST_CHRONOLOGY).otherwise(0)
    )
    return (hints + by_intent).cast("long")


@built_once
def boosted() -> Column:
    """``boost`` of columns of these names."""
    return boost(*(F.col(c) for c in ("text", "repo", "role", "kind", "timestamp", "ids", "prs", "versions", "commits", "repos", "intent")))


def chronology_bonus() -> Column:
    """Ten points for each earlier candidate of the same query, a hundred of them at most; events without a time come first."""
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_first("timestamp"), "event_id")
    return F.least(F.row_number().over(order) - 1, F.lit(X.CHRONOLOGY_MOST)).cast("long") * X.CHRONOLOGY_STEP
