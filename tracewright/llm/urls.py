"""URL rules by a sort-merge range join.

Host labels in reverse order make a host and its subdomains one interval of keys.  Pages and rules are cut into the same key ranges;
within a range both are sorted and one sweep keeps the stack of rules whose interval holds the present key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, tidied

ALLOW, BLOCK = "allow", "block"
_ROWS = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each ended by \\x01, so that a host's key is a prefix of exactly its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, sample: int = 5_000, longest: int = 200) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url); ``rules`` has host, path, verdict.

    A rule fits its host and all subdomains if the page's path starts with the rule's path.  The longest text host + path wins; of
    equally long ones the longer host, then the smaller text.  A page without a fitting rule gets ``default`` and a null rule.  Null
    urls have empty host and path.  Repeated pages are all judged; rules with nulls are left out; repeated rules: the smaller verdict.

    Ranges come from a sample of about ``sample`` page keys, or four a range if that is more, of ``longest`` characters each; the rows
    are chosen on the executors by hash, at a rate that the row count sets, so only the sample reaches the driver.  Ranges only balance
    the work.  A rule goes to each range that its interval meets.  A key ends with the path and a hash of page_id, so one host or url of
    many pages is cut into many ranges.  Extra columns are left out; an empty table has no rows.
    """
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("\x00"), F.col("path"), F.lit("\x00"), F.hex(F.xxhash64("page_id"))))
    n = partitions(pages.sparkSession) * 4
    rate = min(1.0, max(sample, 4 * n) / max(1, pages.count()))
    chosen = p.where(F.shiftrightunsigned(F.xxhash64("key", "page_id"), 32) < int(rate * (1 << 32)))
    drawn = sorted(chosen.select(F.substring("key", 1, longest).alias("key")).toArrow()["key"].to_pylist())
    cuts = sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []

    def bucket(*columns: str):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [pa.array([bisect.bisect_right(cuts, k) for k in batch.column(c).to_pylist()], pa.int32()) for c in columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *(f"{c}_at" for c in columns)])

        return go

    r = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    r = r.withColumn("key", reversed_host(F.col("host"))).withColumn("to", F.concat("key", F.lit("\U0010ffff")))
    r = r.mapInArrow(tidied(bucket("key", "to")), "host string, path string, verdict string, key string, to string, key_at int, to_at int")
    r = r.select(F.explode(F.sequence("key_at", "to_at")).alias("at"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    p = p.mapInArrow(tidied(bucket("key")), "page_id long, host string, path string, key string, key_at int")
    p = p.select(F.col("key_at").alias("at"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    both = r.unionByName(p).repartition(partitions(pages.sparkSession), "at").sortWithinPartitions("at", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rules come before the keys they are a prefix of; the stack holds nested hosts, each with its rules by path."""
        here, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for at, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != here:
                    here, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    stack[-1][2][path] = verdict
                    stack[-1][3].add(len(path))
                    continue
                best = None
                for _, rule_host, by_path, lengths in stack:
                    for n_path in lengths:
                        if n_path <= len(path) and (v := by_path.get(path[:n_path])):
                            text = rule_host + path[:n_path]
                            order = (len(text), len(rule_host))
                            if best is None or order > best[0]:
                                best = (order, text, v)
                out.append((page_id, host, path, best[1] if best else None, best[2] if best else default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 4], strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(tidied(sweep), _ROWS)
