"""Exact deduplication with a separate way for heavy hitters.

Every text becomes its SHA-256.  A Misra-Gries summary (Spark's ``approx_top_k``
keeps one per task, merged in two levels) names digests that may be frequent;
their exact counts and the row that stays are then computed by a map-side
aggregate.  These winners are at most ``heavy`` rows, so they are broadcast and
settle their copies without a shuffle.  All other digests, none of which can hold
more than about one row in ``tracked``, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.sources.storage import stored


def digest_table(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, tag, digest) per row, written once; tags tell repeated rows apart."""
    keys = df.select(
        F.col(f"`{id}`").alias("id"),
        F.monotonically_increasing_id().alias("tag"),
        F.sha2(whole(F.col(f"`{text}`")), 256).alias("digest"),
    )
    return stored(keys, "digests")


def frequent_digests(keys: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """At most ``heavy`` digests that may be frequent."""
    part = F.pmod(F.spark_partition_id(), F.lit(64))
    sketches = keys.groupBy(part.alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("s"))
    # Grouped, so that partitions without a sketch add nothing.
    merged = sketches.groupBy((F.col("part") < 0).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("top")).select("top.item")


def exact_dedup(
    df: DataFrame, text: str = "text", id: str = "doc_id", heavy: int = 1024, tracked: int = 8192
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty are
    one group.  The row with the largest id stays (a null id is smaller than any
    other; of rows repeated with the same id and text one stays).  An empty table
    gives no rows.  Other columns of ``df`` are not looked at.
    """
    keys = digest_table(df, text, id)
    group = [F.max(F.struct("id", "tag")).alias("keep"), F.count(F.lit(1)).alias("group_size")]
    candidates = frequent_digests(keys, heavy, tracked).withColumnRenamed("item", "digest")
    winners = keys.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*group).where("group_size > 1")
    winners = F.broadcast(stored(winners, "winners"))
    settled = keys.join(winners, "digest")
    rest = keys.join(winners, "digest", "left_anti")
    shuffled = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return settled.unionByName(shuffled).select(
        F.col("id").alias(id),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("keep.tag")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, text: str = "text", id: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``df`` that stay, all columns."""
    stay = exact_dedup(df, text, id, **kw).where("kept").select(F.col(id).alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = df.withColumn("__digest", F.sha2(whole(F.col(f"`{text}`")), 256))
    same = (F.col(f"`{id}`").eqNullSafe(F.col("__id"))) & (F.col("__digest") == F.col("__sha"))
    return marked.join(stay, same, "left_semi").dropDuplicates([id, "__digest"]).drop("__digest")
