"""SimHash near-duplicates through a grid over segment popcounts.

A fingerprint is cut into sixteen segments of four bits and mapped to the number of
ones per segment.  The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints, so a range join in that grid loses nothing.
Fingerprints within two bits have a point of the grid within one step of both;
each fingerprint visits its own cell and the up to 32 cells one step away, and only
cells visited by two or more fingerprints go on.  There the step becomes an exact
one: the fingerprints one flipped bit away that fall into the cell.  Two fingerprints
meet at the same flipped fingerprint exactly when they differ in at most two bits,
and at most 65 fingerprints can meet there, so no pair is ever listed that is no
link, and a dense group costs no more per row than a sparse one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.sources.storage import stored

SEED = 42
SEGMENT = 4
SEGMENTS = 64 // SEGMENT
LOWEST = 0x1111111111111111  # the lowest bit of every segment
CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter(
        (h(join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1
    )


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, least significant first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit majority fingerprint of the k-word shingles; 0 without words."""
    hashes = shingle_hashes((text or "").encode().lower().split(), k)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, id: str, k: int = 3) -> DataFrame:
    """(id, fp): one fingerprint per row, as a signed long; texts are read whole."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).astype(np.int64))

    return df.select(F.col(f"`{id}`").alias("id"), of(F.col(f"`{text}`").cast("string")).alias("fp"))


def popcounts(fp: Column) -> Column:
    """Ones per four-bit segment, each in its own four bits."""
    planes = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(LOWEST)) for i in range(SEGMENT)]
    return planes[0] + planes[1] + planes[2] + planes[3]


def _count_at(vector: Column, segment: int) -> Column:
    return F.shiftrightunsigned(vector, SEGMENT * segment).bitwiseAND(F.lit(15))


def visits(fps: DataFrame) -> DataFrame:
    """(cell, fp, segment): the cells within one step; segment -1 is the own cell."""
    v = F.col("vector")
    stay = F.struct(v.alias("cell"), F.lit(-1).alias("segment"))
    steps = []
    for s in range(SEGMENTS):
        one = F.lit(1 << (SEGMENT * s)).cast("long")
        up = F.struct((v + one).alias("cell"), F.lit(s).alias("segment"))
        down = F.struct((v - one).alias("cell"), F.lit(s).alias("segment"))
        steps += [F.when(_count_at(v, s) < SEGMENT, up), F.when(_count_at(v, s) > 0, down)]
    cells = fps.select("fp", popcounts(F.col("fp")).alias("vector")).select(
        "fp", F.explode(F.array_compact(F.array(stay, *steps))).alias("at")
    )
    return cells.select("at.cell", "fp", "at.segment")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints that join all within two bits.

    Every fingerprint is linked to the smallest one at each place where it meets
    others, so links connect exactly what chains of at most two bits connect.
    """
    visited = visits(fps)
    busy = visited.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("cell")
    # Spark takes up to 33 visits for the size of one fingerprint, so it would broadcast millions of cells.
    met = visited.join(busy.hint("merge"), "cell")
    fp, s = F.col("fp"), F.col("segment")
    bits = F.array(*[F.lit(i) for i in range(SEGMENT)])
    flipped = F.transform(bits, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), SEGMENT * s + i)))
    exact = F.when(s < 0, F.array(fp)).otherwise(F.filter(flipped, lambda z: popcounts(z) == F.col("cell")))
    places = met.select("fp", F.explode(exact).alias("place"))
    # At most 65 fingerprints lie within one bit of a place.
    meeting = places.groupBy("place").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()


def simhash_classes(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 3) -> DataFrame:
    """Per row: id, fp (signed long) and the smallest id reachable over two-bit links.

    Null and empty texts, and texts of white space, have fingerprint zero and link
    like any other; rows repeated count once each; null ids are never the smallest
    (a class of null ids alone has none).  An empty table gives no rows.
    """
    rows = stored(fingerprints(df, text, id, k), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    links = connected_components(fingerprint_links(distinct.select("fp")))
    linked = stored(links.select(F.col("node").alias("fp"), "root"), "roots")
    roots = linked.unionByName(linked.select(F.col("root").alias("fp"), "root")).distinct()
    smallest = distinct.join(roots, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    merged = roots.join(smallest, "root").select("fp", "smallest")
    named = distinct.join(merged, "fp", "left").select(
        "fp", F.when(F.col("smallest").isNotNull(), F.col("smallest")).otherwise(F.col("first")).alias("component_id")
    )
    return rows.join(named, "fp").select(F.col("id").alias(id), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 3) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of each class of ``simhash_classes`` one.

    The row with the smallest id stays, null ids last; of rows that share it, any one.
    Every row is judged for itself, whatever its id, so rows repeated are one class.
    An empty table gives no rows.
    """
    tag = "tag"
    while tag in df.columns:
        tag += "_"
    tagged = stored(df.withColumn(tag, F.monotonically_increasing_id()), "tagged")
    classes = simhash_classes(tagged, text, tag, k).select(tag, "component_id")
    named = classes.join(tagged.select(tag, F.col(f"`{id}`").alias("id")).alias("t"), tag)
    first = F.min(F.struct(F.col("id").isNull(), "id", tag)).alias("first")
    stay = named.groupBy("component_id").agg(first).select(F.col("first")[tag].alias(tag))
    return tagged.join(stay, tag, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
