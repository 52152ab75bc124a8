"""Tables that Spark sizes too low are not broadcast: cells after an explode, copies of blocks."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg
from tidemark.llm.simhash import fingerprint_links


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_broadcast(spark):
    fps = spark.range(500).select((F.col("id") * 7919).alias("fp"))
    assert "Broadcast" not in planned(fingerprint_links(fps))


@pytest.fixture(scope="module")
def embeddings(spark):
    x = [((F.col("id") * (j + 3)) % 19 / 19.0 - 0.4).cast("float") for j in range(6)]
    return spark.range(0, 90, 1, 3).select(F.col("id").alias("vec_id"), F.array(*x).alias("embedding"), (F.col("id") % 4).cast("int").alias("label"))


def test_blocks_meet_without_exchange_or_broadcast(spark, embeddings):
    rows = hardneg.quantised(embeddings, "embedding", "vec_id", F.col("label"), 256)
    lines, every = hardneg.blocks(rows.where("id % 5 = 0"), 18, 4, 6), hardneg.blocks(rows, 90, 16, 6)
    met = hardneg.tiles(lines, every)
    plan = planned(met)
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Exchange" not in plan
    assert met.count() == lines.count() * every.count() > 9
    assert met.select("a_block", "block").distinct().count() == met.count()


def test_blocks_of_any_size_give_the_same_negatives(spark, embeddings):
    found = [
        sorted(map(tuple, hardneg.hard_negatives(embeddings, F.col("id") % 5 == 0, anchor_block=a, row_block=b).collect()))
        for a, b in ((512, 4096), (4, 16))
    ]
    assert found[0] == found[1] and len(found[0]) > 50
