"""Queries over the driver's tables, one for each operator, with SQL that says the same.

Conversations serve as sessions and events, documents as texts, pages as working directories and customers as a forest of sessions.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import fixed as X
from ..functions import questions as Q, redact as R, text as T
from ..operators import lineage as L, packet as P, ranking as K
from ..operators.normalize import parse
from ..sources import rollouts
from .index import diff, EvidenceIndex, models_of, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as events: event_id, session_id, seq, role, kind, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("event_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.lit("response_message").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def parse_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct("text")).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    broken = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    lines = c.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).alias("line"), F.lit(0).cast("long").alias("byte_offset"), F.encode(broken, "UTF-8").alias("raw"), F.lit(False).alias("oversized"))
    out = parse(lines)
    events = out.events.select("path", F.col("line_no").alias("line"), "kind", "role", "text", "seq")
    return events.unionByName(out.warnings.select("path", "line", "kind", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("seq")))


def _lines(rows: DataFrame, record, path: str, *order: str) -> DataFrame:
    """Rows of a table as log lines: files by ``path``, lines in ``order``, ``record`` as their text."""
    number = F.row_number().over(W.partitionBy(path).orderBy(*order)).cast("long")
    return rows.select(F.col(path).cast("string").alias("path"), number.alias("line"), F.lit(0).cast("long").alias("byte_offset"), F.encode(record, "UTF-8").alias("raw"), F.lit(False).alias("oversized"))


def _record(kind: str, payload) -> object:
    return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))


def event_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = _record("response_item", F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("x").alias("text"))).alias("content")))
    return parse(_lines(c, said, "conv_id", "turn")).events.select(F.col("path").alias("session_id"), "seq", "role", K.field_of(F.col("role")).alias("field"))


def turn_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are turns; all other events are messages within them."""
    e = table(spark, sf_dir, "events")
    own = F.col("event_id").cast("string")
    context, message = _record("turn_context", F.struct(own.alias("turn_id"))), _record("event_msg", F.struct(F.lit("agent_message").alias("type"), own.alias("message")))
    events = parse(_lines(e, F.when(F.col("event_type") == "signup", context).otherwise(message), "user_id", "ts", "event_id")).events
    event_id = F.when(F.col("kind") == "turn_context", F.col("turn_id")).otherwise(F.col("text"))
    return events.select(event_id.cast("long").alias("event_id"), F.col("path").cast("long").alias("user_id"), F.col("turn_id").cast("long").alias("turn_id"))


def first_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = F.col("event_id").cast("string")
    record = F.when(F.col("event_type") == "signup", _record("session_meta", F.struct(own.alias("id")))).otherwise(_record("event_msg", F.struct(F.lit("agent_message").alias("type"), own.alias("message"))))
    return parse(_lines(e, record, "user_id", "ts", "event_id")).sessions.select(F.col("path").cast("long").alias("user_id"), F.col("id").cast("long").alias("event_id"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number field as a number, as text, as a negative number, with a fraction and in a list: only the first is one."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r":\s*([0-9]+)", 1)
    said = F.element_at(F.array(k, F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit("-1"), k), F.concat(k, F.lit(".5")), F.concat(F.lit("["), k, F.lit("]"))), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.concat(F.lit('{"type":"event_msg","payload":{"type":"task_complete","turn_id":"'), F.col("event_id").cast("string"), F.lit('","duration_ms":'), said, F.lit("}}"))
    return parse(_lines(e, line, "user_id", "event_id")).events.select(F.col("turn_id").cast("long").alias("event_id"), F.col("duration_ms").alias("k"))


def parse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of record in turn, with blank, oversized, typeless and foreign lines between; events and warnings."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    raw = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    stamped = lambda kind, *payload: raw('{"timestamp":"t', n, f'","type":"{kind}","payload":{{', *payload, "}}")
    kinds = [
        stamped("turn_context", '"turn_id":"turn', n, '","model":"m', n, '","cwd":"/w/', n, '"'),
        stamped("event_msg", '"type":"user_message","message":"ask ', n, '","images":["/i', n, '.png",7],"audio":[]'),
        stamped("event_msg", '"type":"agent_message","phase":"final_answer","message":"done ', n, '"'),
        stamped("event_msg", '"type":"agent_message","phase":"commentary","message":"on it ', n, '"'),
        stamped("event_msg", '"type":"task_complete","last_agent_message":"over ', n, '","duration_ms":', n),
        stamped("response_item", '"type":"function_call","name":"run","arguments":"x', n, '","call_id":"c', n, '"'),
        stamped("response_item", '"type":"custom_tool_call","input":{"z":', n, ',"a":[1]},"id":"d","status":"ok"'),
        F.lit(" "),
        F.lit("long"),
        F.lit('{"payload":{}}'),
        stamped("other", '"type":"user_message","message":"no"'),
        stamped("event_msg", '"type":"turn_complete","status":"failed"'),
        stamped("response_item", '"type":"message","role":"robot","content":[{"input_text":"in ', n, '"},{"text":5},{"output_text":"out"}]'),
    ]
    lines = _lines(e, F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int")), "user_id", "event_id").withColumn("oversized", F.col("raw") == F.encode(F.lit("long"), "UTF-8"))
    out = parse(lines.withColumn("raw", F.when(~F.col("oversized"), F.col("raw"))))
    columns = ["path", "line_no", "kind", "seq", "timestamp", "turn_id", "role", "text", "phase", "model", "status", "duration_ms", "tool_name", "call_id"]
    warnings = out.warnings.select("path", F.col("line").alias("line_no"), "kind")
    return out.events.select(columns).unionByName(warnings, allowMissingColumns=True)


def bound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, long = T.bound_text(F.col("text"), 1000)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cut, 256).alias("sha"), F.octet_length(cut).cast("long").alias("n_bytes"), long.alias("truncated"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = R.redact(F.col("text"), "/home/someone")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("n_chars_left"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", R.redact(F.col("text"), "").alias("t"))
    return d.groupBy("source").agg(F.count_if(F.col("t").contains("[REDACTED:SECRET]")).alias("secrets"), F.count_if(F.col("t").contains("[REDACTED:")).alias("any_kind"), F.count("*").alias("n"))


#: (Spark and DuckDB) texts with planted secrets, by doc_id % 8.
PLANTED = [
    "header Authorization: Bearer q7.Rk-88_zz~", "curl -H Basic cGxhbnRlZDpzZWNyZXQ=", "id eyJrIjoxfQx.eyJ1IjoyfQy.mark_77-q end", "gh" + "o_plantedplanted12 and xox" + "b-planted-0000",
    '{"refresh_token": "planted", "kind": "k"}', "export MAIL_TOKEN=''planted one'' # note", "passwd: planted1; secret=planted2", "-----BEGIN EC PRIVATE KEY----- planted -----END EC PRIVATE KEY----- rest",
]


def redact_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.element_at(F.array(*(F.lit(p.replace("''", "'")) for p in PLANTED)), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.concat(planted, F.lit(" "), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", R.redact(text, "").alias("redacted"))


def redact_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, titles, marks of direction and bells around texts and paths below a home directory."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("\x1b[31m"), "lang", F.lit("\x1b[0m \u202e"), "source", F.lit("\x07\x1b]0;title\x07 /home/someone/"), n, F.lit("\\x\ty\n\x9b1m\ufeff"))
    return table(spark, sf_dir, "documents").select("doc_id", R.redact(text, "/home/someone").alias("redacted"), R.safe_display_path(text, "/home/someone").alias("shown"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.content_hash(F.col("role"), F.lit("response_message"), F.coalesce("text", F.lit(""))).alias("content_hash"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are queries and documents their candidates, best first by doc_id."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.lit("").alias("root_id"), F.lit("").alias("session_id"), F.lit(0).alias("score"), F.col("doc_id").alias("seq"), T.content_hash(F.lit("user"), F.lit("user_message"), F.coalesce("text", F.lit(""))).alias("content_hash"))
    return P.keep_first(d).select(F.col("query_id").alias("source"), "content_hash", F.col("seq").alias("doc_id"))


def repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.repo_name(F.col("url")).alias("repo"))


def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(T.tokenize(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ").alias("normalized"))


def select_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.select_terms(T.tokenize(F.col("text"))), " ").alias("terms"))


def hint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(Q.version_hints(F.col("text")), ",").alias("versions"))


def hint_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(Q.commit_hints(F.col("text")), ",").alias("commits"))


def hint_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.col("p_brand"), F.lit(" pr "), F.col("p_size").cast("string"), F.lit(", pull request #007"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(Q.pr_hints(q), lambda n: n.cast("string")), ",").alias("prs"))


def hint_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(Q.repo_hints(F.col("url")), Q.canonical_repo), ",").alias("repos"))


def hint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier after a word, one after a label, one of each document's digits in the form of a UUID, and one that is too short."""
    k, h = F.col("p_partkey").cast("string"), F.md5(F.col("p_partkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    q = F.concat(F.lit("In Session Ab-"), k, F.lit("-cdefg, thread tooshrt, run = R"), k, F.lit("x of "), F.upper(uuid))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(Q.id_hints(q), ",").alias("ids"))


def hint_named_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository after its keyword, a slug, and a name that is no name."""
    k = F.col("p_partkey").cast("string")
    q = F.concat(F.lit("the repository called `Acme_"), k, F.lit("` and my-cool-App"), k, F.lit(" of project the, not two-words"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(Q.repo_hints(q), Q.canonical_repo), ",").alias("repos"))


def query_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions trimmed and cut, and their terms as a match expression."""
    q = F.concat(F.lit(" \n\t"), F.col("text"), F.lit("  "))
    return Q.analyze(table(spark, sf_dir, "documents").select("doc_id", q.alias("query"))).select("doc_id", F.length("query").cast("long").alias("n"), F.sha2("query", 256).alias("sha"), F.size("terms").cast("long").alias("n_terms"))


QUESTIONS = [
    ("Why did we choose this for", "why"), ("How was it implemented in", "how"), ("What work is still pending in", "unfinished"), ("Give a timeline of", "chronology"), ("Which model handled", "model"),
    ("Trace the screenshot lineage of", "attachment"), ("Find the release command of", "general"), ("Why did the model ignore the attachment in", "why"), ("From 1.2.3 to 1.2.4 in", "chronology"), ("the decision about", "why"),
]


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q, _ in QUESTIONS], "q string")
    both = table(spark, sf_dir, "nation").join(F.broadcast(asked)).select("n_nationkey", "q", F.concat_ws(" ", "q", "n_name").alias("query"))
    return Q.analyze(both).select("n_nationkey", "q", "intent")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = K.postings(conversation_events(spark, sf_dir), stemmed=False)
    df = posted.groupBy("term").agg(F.count_distinct("event_id").alias("df"), F.sum("tf").alias("tf"))
    return df


ASKED = "(0, 'the'), (1, 'and'), (2, 'ther')"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, "the"), (0, 1, "and"), (0, 2, "ther")], "query_id int, pos int, term string")


def _scored(spark: SparkSession, sf_dir: str, weighted: bool, stemmed: bool = False) -> DataFrame:
    events, terms = conversation_events(spark, sf_dir), _asked(spark)
    terms = terms.withColumn("term", T.stem("term")) if stemmed else terms
    scored = K.bm25(terms, K.scan_hits(terms, events, weighted, stemmed), K.corpus(events))
    return scored.withColumn("score", K.quantised(F.col("score")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False).orderBy(F.desc("score"), "event_id").limit(100).select("event_id", "score")


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).orderBy(F.desc("score"), "event_id").limit(100).select("event_id", "score")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(T.select_terms(T.document_tokens(F.col("text")))).alias("pos", "term"))
    return K.best_by_scan(items, docs, 5).select(F.col("query_id").alias("item_id"), F.col("event_id").alias("doc_id"), "score", "place")


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True, stemmed=True).orderBy(F.desc("score"), "event_id").limit(100).select("event_id", "score")


def structured_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = conversation_events(spark, sf_dir)
    hint = F.array(F.struct(F.lit(None).cast("string").alias("owner"), F.lit("1").alias("name")))
    boost = K.boost(F.col("text"), F.col("session_id"), F.col("role"), F.col("kind"), F.lit(None).cast("string"), F.array(F.lit("the")), F.array(F.lit(1).cast("long")), F.array(F.lit("ing")), F.array(F.lit("and"), F.lit("zzz")), hint, F.lit("why"))
    return e.select("event_id", boost.alias("boost"))


def boost_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sources as repositories, two of which the question names; null for one language."""
    d = table(spark, sf_dir, "documents")
    repo = F.when(F.col("lang") != "fr", F.upper("source"))
    hints = F.array(*(F.struct(F.lit(o).cast("string").alias("owner"), F.lit(n).alias("name")) for o, n in ((None, "src1"), ("x", "src2"), (None, "SRC3"))))
    none, no = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    boost = K.boost(F.lit("text"), repo, F.lit("tool"), F.when(F.col("doc_id") % 2 == 0, "task_complete").otherwise("tool_call"), no, none, F.lit(None).cast("array<long>"), none, none, hints, F.lit("how"))
    return d.select("doc_id", boost.alias("boost"))


def chronology_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("query_id"), F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"))
    return e.select("event_id", K.chronology_bonus().alias("bonus"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events of one question with what the packet needs; sessions of equal conv_id % 50 have the same root."""
    events = conversation_events(spark, sf_dir).withColumn("content_hash", T.content_hash(F.col("role"), F.col("kind"), F.col("text")))
    return K.top(_scored(spark, sf_dir, True), 480).join(events, "event_id").withColumn("root_id", F.concat(F.lit("r"), (F.col("session_id").cast("long") % 50).cast("string")))


def session_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_sessions(_candidates(spark, sf_dir), 5).select("session_id", "score")


def evidence_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    rows = P.evidence(c, P.top_sessions(c, 5), 12)
    more = {"turn_id": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("string"), "path": F.concat(F.lit("logs/"), "session_id", F.lit(".jsonl")), "line_no": F.col("seq") + 1, "byte_offset": F.lit(0)}
    return P.cited(rows.withColumns(more)).select("session_id", "root_id", "role", "text", "citation", "source", "score")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of four queries whose candidates' scores are a rule of their numbers."""
    e = conversation_events(spark, sf_dir).withColumn("n", F.col("session_id").cast("long") * 31 + F.col("seq"))
    e = e.withColumns({"query_id": F.col("session_id").cast("long") % 4, "score": F.col("n") * 7919 % 1009, "root_id": F.concat(F.lit("r"), F.col("session_id").cast("long") % 10), "content_hash": F.md5(F.col("role")), "timestamp": F.when(F.col("n") % 5 > 0, F.concat(F.lit("t"), F.col("n") % 3)), "turn_id": F.lit(None).cast("string"), "path": F.concat(F.lit("/l/"), "session_id"), "line_no": F.col("seq") + 1, "byte_offset": F.col("seq") * 10})
    e = e.withColumn("content_hash", F.md5(F.concat("role", (F.col("n") % 3).cast("string"))))
    sessions = e.select("session_id", "root_id", F.concat(F.lit("repo"), F.col("session_id").cast("long") % 3).alias("repo"), F.lit("complete").alias("provenance_status")).distinct()
    asked = spark.createDataFrame([(i, f"say `{i}`", "general") for i in range(5)], "query_id long, query string, intent string")
    return P.packets(asked, e, sessions, 3, 7)


def packet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in its final order: score, time, session, line."""
    listed = _packets(spark, sf_dir).select("query_id", "query", F.size("matched_sessions").cast("long").alias("sessions"), F.posexplode("evidence").alias("place", "e"))
    return listed.select("query_id", "query", "sessions", F.col("place").cast("long").alias("place"), "e.session_id", "e.root_id", "e.timestamp", "e.citation", "e.source", "e.line", "e.byte_offset", F.col("e.score").cast("long").alias("score"))


def packet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _packets(spark, sf_dir).select("query_id", F.posexplode("matched_sessions").alias("place", "m"))
    return listed.select("query_id", F.col("place").cast("long").alias("place"), "m.session_id", "m.root_id", "m.repo", "m.provenance_status", F.col("m.score").cast("long").alias("score"))


def packet_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, counts and ends of whole Markdown packets, and of the packet without evidence; bodies as hashes."""
    return P.markdown(_packets(spark, sf_dir)).select("query_id", F.split("markdown", "\n\n    |\n- ")[0].alias("head"), F.sha2("markdown", 256).alias("sha"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    parent = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, -k).when((k % 11 == 2) & (k % 2 == 0), k).when(k % 11 == 5, k + 1).when(k % 11 == 6, k - 1).otherwise(k - 1)
    return L.resolve(c.select(k.cast("string").alias("session_id"), parent.cast("string").alias("parent_id")))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size_bytes"), F.lit("0").alias("mtime_ns"), F.col("lang").alias("fingerprint"))
    known = d.where("doc_id % 10 <> 3").drop("doc_id")
    now = d.where("doc_id % 10 <> 5").select("path", (F.col("size_bytes") + F.when(F.col("doc_id") % 10 == 7, 1).otherwise(0)).alias("size_bytes"), F.when(F.col("doc_id") % 10 == 8, "1").otherwise(F.col("mtime_ns")).alias("mtime_ns"), "fingerprint")
    return diff(known, now)


def models_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as models of turns."""
    e = table(spark, sf_dir, "events")
    events = parse(_lines(e, _record("turn_context", F.struct(F.col("event_type").alias("model"))), "user_id", "event_id")).events
    return models_of(events).select(F.col("path").cast("long").alias("user_id"), "models")


def _log_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which executors see too; where that is unset or no local folder, a temporary one."""
    shared = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", spark.conf.get("spark.checkpoint.dir", None) or "")
    if shared:
        os.makedirs(shared[1], exist_ok=True)
    base = os.path.realpath(tempfile.mkdtemp(prefix="tracewright-logs-", dir=shared and shared[1]))
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def _write_logs(c: DataFrame, base: str, whole: bool) -> None:
    """conversations as log files, written by the tasks that have their rows, one after the other; not ``whole``, only even ones, every
    other of them with one line."""

    def place(k: int) -> str:
        return f"{base}/logs/{'ab'[k % 2]}/{k:06d}.jsonl"

    def done(out: IO[str], k: int) -> None:
        """The old file goes first: file systems flush a file that is renamed over another, which takes milliseconds each."""
        out.close()
        with contextlib.suppress(FileNotFoundError):
            os.remove(place(k))
        os.rename(out.name, place(k))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, files, out = None, 0, 0, None
        for batch in batches:
            for k, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")), strict=True):
                lines = []
                if k != at:
                    if out:
                        done(out, at)
                    at, n, files, out = k, 0, files + 1, open(f"{place(k)}.{uuid.uuid4().hex}", "w", encoding="utf-8")  # noqa: SIM115
                    if k % 7:
                        lines.append(json.dumps({"type": "session_meta", "payload": {"id": f"s{k}", "cwd": f"/w/repo{k % 5}", "timestamp": "t0", **({"forked_from_id": f"s{k - 2}"} if k % 3 == 0 else {})}}))
                lines.append(json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"text": text}]}}, ensure_ascii=False))
                lines = lines if whole or k % 4 else lines[: max(0, 1 - n)]
                n += len(lines)
                out.writelines(line + "\n" for line in lines)
        if out:
            done(out, at)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    rows = c.where("conv_id is not null" if whole else "conv_id % 2 = 0").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "role", "text").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _index(spark: SparkSession, sf_dir: str) -> tuple[EvidenceIndex, list[str], str]:
    """An index over conversations written as log files, one a conversation: the even ones first, then all, after one has grown and
    one has gone; every seventh has no session record."""
    base = _log_folder(spark)
    os.makedirs(f"{base}/logs/b")
    os.makedirs(f"{base}/logs/a")
    c = table(spark, sf_dir, "conversations")
    last = c.agg(F.max("conv_id").alias("k")).first().k
    index = EvidenceIndex(spark, f"{base}/db")
    for turn in (0, 1):
        _write_logs(c, base, bool(turn))
        if turn and last is not None:
            os.remove(f"{base}/logs/{'ab'[last % 2]}/{last:06d}.jsonl")
        index.refresh([f"{base}/logs"])
    return index, [f"{base}/logs"], base


_indexes: dict[tuple[str, str], tuple[EvidenceIndex, list[str], str]] = {}


def _shared_index(spark: SparkSession, sf_dir: str) -> tuple[EvidenceIndex, list[str], str]:
    """``_index``, made once for queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = _index(spark, sf_dir)
    return _indexes[key]


def index_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that an index holds after two refreshes.  Logs and index lie in a folder that driver and executors share."""
    return _shared_index(spark, sf_dir)[0].table("events").select("session_id", "seq", "line_no", "role", "kind", F.sha2("text", 256).alias("sha"), "content_hash")


def index_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared_index(spark, sf_dir)[0].table("sessions").select("session_id", "cwd", "repo", "parent_id", "root_id", "provenance_status", "thread_source", "timestamp")


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the index with their counts, and the discovered order of all files."""
    index, logs, base = _shared_index(spark, sf_dir)
    found = numbered(rollouts.listing(spark, logs, f"{base}/listing-{uuid.uuid4().hex}"), f"{base}/places-{uuid.uuid4().hex}")[0]
    found = found.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "place")
    held = index.table("files").select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "session_id", "n_events")
    return found.join(held, "path", "left").select("path", "place", "session_id", "n_events")


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the index's postings count for each event, and the lengths they carry."""
    index = _shared_index(spark, sf_dir)[0]
    return index.table("postings").groupBy("event_id").agg(F.sum("tf").alias("words"), F.max("dl").cast("long").alias("length")).join(index.table("events"), "event_id").select("session_id", "seq", "words", "length")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a refresh that finds nothing new, of a rebuild, and of a refresh after the last file of folder a is gone."""
    index, logs, _ = _index(spark, sf_dir)
    stats = [index.refresh(logs), index.rebuild(logs)]
    os.remove(max(p for p in rollouts.walk(logs) if "/a/" in p))
    stats.append(index.refresh(logs))
    names = list(asdict(stats[0]))
    return spark.createDataFrame([(i, *asdict(s).values()) for i, s in enumerate(stats)], "run long, " + ", ".join(f"{n} long" for n in names))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.text_lines(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha"), T.single_line(F.concat("lang", F.lit("`\n"), "source")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_rollouts, event_normalize, turn_carry, first_meta, json_field, bound_text, redact_text, redact_counts, redact_synthetic, content_hash, exact_dedup, repo_name, tokenize_query, select_terms, hint_versions, hint_commits,
        hint_prs, hint_repos, hint_ids, hint_named_repos, query_bounds, parse_kinds, redact_controls, boost_repo, packet_order, packet_sessions, packet_markdown, index_events, index_sessions, index_files, index_postings, index_stats, intent, corpus_stats, bm25_topk, bm25_fields, bm25_batch, bm25_stemmed, structured_boost, chronology_bonus, session_topk, evidence_packet, lineage, incremental_diff, models_by_session, markdown_lines,
    )
}
