"""URL rules applied by a sort-merge range join.

The labels of a host are reversed and joined (``a.example.net`` becomes ``net.example.a.``), so a rule's host covers
exactly the interval of keys that start with its own key; intervals nest or are apart. Urls and rules are dealt to
shards by ranges of the key, a rule to every shard that its interval meets, and sorted in each. One sweep over the
sorted rows keeps the stack of rules whose interval holds the present key; the paths decide among them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 64  # sampled keys a shard
SHARDS = 4  # shards a shuffle partition
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The stack of rules over the present key; each level holds the paths of one rule host."""

    def __init__(self):
        self.shard, self.stack = None, []

    def move(self, shard: int, key: str) -> None:
        if shard != self.shard:
            self.shard, self.stack = shard, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def push(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, host))
        paths = self.stack[-1][1]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict

    def best(self, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule and its verdict; of equally long ones that of the longer host."""
        rule, verdict = None, None
        for _, paths, host in reversed(self.stack):
            least = len(rule) - len(host) if rule is not None else -1
            for size in sorted({len(p) for p in paths if len(p) <= len(path)}, reverse=True):
                if size <= least:
                    break
                if (found := paths.get(path[:size])) is not None:
                    rule, verdict = host + path[:size], found
                    break
        return rule, verdict


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict (``default`` then) of every row.

    ``rules`` has host, path (starting with ``/``) and verdict; of rules with equal host and path a block wins, rules
    with a null field are left out. Null urls and those without ``://`` have an empty host and path, which no rule
    fits. Repeated and null page_ids keep a row each; an empty table gives none; other columns are not read.
    """
    spark = pages.sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col("page_id").cast("long").alias("page_id"))
    # A host may hold a third of all rows, and one url too: the order goes on by path and by a number of the row.
    urls = urls.select(reversed_key(F.col("host")).alias("key"), "path", F.rand(11).alias("salt"), "host", "page_id")
    sample = urls.select("key", "path", "salt", F.xxhash64("page_id", "path", "salt").alias("h")).orderBy("h").limit(SAMPLE * shards).toArrow()
    keys = sorted(zip(*(sample.column(c).to_pylist() for c in ("key", "path", "salt"))))
    bounds = [keys[k * len(keys) // shards] for k in range(1, shards)] if keys else []
    shipped = spark.sparkContext.broadcast(bounds)  # one a shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "salt")))
            shard = pa.array([bisect_right(shipped.value, x) for x in at], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *(batch.column(c) for c in ("key", "path", "host", "page_id"))], names=["shard", "key", "path", "host", "page_id"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, host, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                first, last = bisect_right(shipped.value, (key, "", -1.0)), bisect_right(shipped.value, (key[:-1] + "/", "", -1.0))
                rows += [(s, key, path, host, verdict) for s in range(first, last + 1)]
            columns, kinds = list(zip(*rows)) or [()] * 5, (pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "key", "path", "host", "verdict"])

    dealt = urls.mapInArrow(deal, "shard int, key string, path string, host string, page_id long")
    given = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), "path", "verdict").dropna().distinct()
    given = given.select(reversed_key(F.col("host")).alias("key"), "path", "host", "verdict")
    spread_rules = given.mapInArrow(spread, "shard int, key string, path string, host string, verdict string")
    rows = dealt.withColumns({"verdict": F.lit(None).cast("string"), "kind": F.lit(1)}).unionByName(
        spread_rules.withColumns({"page_id": F.lit(None).cast("long"), "kind": F.lit(0)})
    )
    rows = rows.repartition(shards // SHARDS, "shard").sortWithinPartitions("shard", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("shard", "key", "kind", "path", "host", "page_id", "verdict"))
            for shard, key, kind, path, host, page_id, verdict in zip(*columns):
                state.move(shard, key)
                if kind:
                    rule, said = state.best(path)
                    found.append((page_id, host, path, rule, said or default))
                else:
                    state.push(key, host, path, verdict)
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
