"""URL rules by a sort-merge range join over reversed hosts.

A host reversed label by label turns "this host and all its subdomains" into one
interval of keys.  Rules and urls are range-partitioned together by that key and
swept in order with a stack of the rules whose interval is open; intervals of
prefixes nest, so only the top of the stack ever closes.  A partition starts with
the rules of all ancestors of its first key, so ranges may cut anywhere, also
within one host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.sources.storage import stored

# Letters of either case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """``net.example.www.``: an ancestor's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(default: str):
    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, stack = None, []  # stack: (reversed host, {rule path: (rule, verdict)}, path lengths)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.pid != pid:
                    pid, stack = row.pid, []
                while stack and not row.rev.startswith(stack[-1][0]):
                    stack.pop()
                if row.kind == 0:
                    if not stack or stack[-1][0] != row.rev:
                        stack.append((row.rev, {}, []))
                    paths = stack[-1][1]
                    paths[row.path] = (row.rule, row.verdict)
                    stack[-1][2][:] = sorted({len(p) for p in paths}, reverse=True)
                    continue
                hit = (None, default)
                if row.real:
                    fits = (
                        paths[row.path[:n]]
                        for _, paths, sizes in reversed(stack)
                        for n in sizes
                        if n <= len(row.path) and row.path[:n] in paths
                    )
                    hit = next(fits, hit)
                out.append((row.tag, *hit))
            if out:
                yield pd.DataFrame(out, columns=["tag", "rule", "verdict"])

    return sweep


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    url: str = "url",
    id: str = "page_id",
    default: str = "allow",
) -> DataFrame:
    """Per row: id, host, path, rule and verdict.

    ``rules`` are (host, path, verdict); a rule fits its host and all subdomains if
    the url's path starts with the rule's path.  The longest host wins, then the
    longest path; of rules alike one wins, the later verdict in alphabetical order.
    Without a rule the verdict is ``default``; null urls and urls without ``://`` have
    no rule.  Repeated rows are judged one by one; an empty table gives no rows;
    other columns are not looked at.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([*rules], "host string, path string, verdict string")
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = df.select(F.col(f"`{id}`").alias("id"), host.alias("host"), path.alias("path"), (F.instr(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), "://") > 0).alias("real"))
    none = F.lit(None).cast("string")
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    ruled = one.select(reversed_host(F.col("host")).alias("rev"), F.lit(0).alias("kind"), "path", F.concat("host", "path").alias("rule"), "verdict")
    events = urls.select(
        reversed_host(F.col("host")).alias("rev"), F.lit(1).alias("kind"), "path", none.alias("rule"), none.alias("verdict"), "id", "host", "real"
    ).unionByName(ruled, allowMissingColumns=True)
    n = partitions(spark)
    ranged = events.withColumn("spread", F.xxhash64("path", "id")).repartitionByRange(n, "rev", "kind", "spread").drop("spread")
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("tag")), "url-ranges")
    first = ranged.groupBy("pid").agg(F.min("rev").alias("first"))
    labels = F.split("first", r"\.")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit("."))
    )
    carried = first.select("pid", F.explode(ancestors).alias("rev")).join(ruled, "rev")
    sweep_columns = ["pid", "rev", "kind", "path", "rule", "verdict", "real", "tag"]
    ordered = (
        ranged.select(*sweep_columns, F.lit(1).alias("phase"))
        .unionByName(carried.withColumn("phase", F.lit(0)), allowMissingColumns=True)
        .repartition(n, "pid")
        .sortWithinPartitions("pid", "phase", "rev", "kind")
    )
    judged = ordered.select(*sweep_columns).mapInPandas(_sweep(default), "tag long, rule string, verdict string")
    return ranged.where("kind = 1").join(judged.withColumnsRenamed({"rule": "r", "verdict": "v"}), "tag").select(
        F.col("id").alias(id), "host", "path", F.col("r").alias("rule"), F.col("v").alias("verdict")
    )
