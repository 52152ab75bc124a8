"""Conversations of any length as rows."""

from pyspark.sql import functions as F

from tidemark.operators.index import running_total
from tidemark.operators.texteval import conversation_records, flatten_chat, flatten_turns


def test_turns_joined_give_the_whole_text(spark):
    n = F.col("id")
    df = spark.range(13_000).select(
        F.when(n < 9_000, "hot").otherwise(F.concat(F.lit("c"), (n % 500).cast("string"))).alias("conv_id"),
        n.alias("turn"),
        F.when(n % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.repeat(F.lit("ü"), (n % 4).cast("int")).alias("text"),
    ).repartition(5)
    whole = {r.conv_id: r.text for r in flatten_chat(conversation_records(df)).collect()}
    assert len(whole) == 501 and whole["hot"].count("<|im_start|>") == 9_000
    turns = sorted(flatten_turns(df).collect(), key=lambda r: (r.conv_id, r.turn))
    joined, at = {}, {}
    for r in turns:
        assert r.at == at.get(r.conv_id, 0)
        joined.setdefault(r.conv_id, []).append(r.text)
        at[r.conv_id] = r.at + len(r.text)
    assert {k: "".join(v) for k, v in joined.items()} == whole


def test_running_total_of_null_groups_and_values(spark):
    rows = [(None, 1, 5), (None, 2, None), (None, 3, 7), ("a", 1, None), ("a", 2, -2)]
    out = running_total(spark.createDataFrame(rows, "g string, o int, v long"), "v", ("g",), ("o",), "s")
    assert sorted((r.g or "", r.o, r.s) for r in out.collect()) == [("", 1, 5), ("", 2, 5), ("", 3, 12), ("a", 1, 0), ("a", 2, -2)]
    assert running_total(out.drop("s").limit(0), "v", ("g",), ("o",), "s").count() == 0
