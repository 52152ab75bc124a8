"""Checks of explanation texts against what they should and should not say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import running_total

# Terms that point to outside knowledge, and causal promises.
EXTERNAL_TERMS = ("earnings", "revenue", "ceo", "guidance", "fed", "macroeconomic", "rumor", "news")
CAUSAL_TERMS = ("guarantees", "will cause", "surely make", "ensures profit")

def _found(terms: Sequence[str], text: Column) -> Column:
    hits = [F.when(text.contains(t), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits))


def evaluate_texts(
    df: DataFrame, text: str = "text", label: str = "label", features: str = "features"
) -> DataFrame:
    """Add the five checks to every row: substring tests on the whole lower-cased text."""
    low = F.lower(F.col(text))
    external, causal = _found(EXTERNAL_TERMS, low), _found(CAUSAL_TERMS, low)
    grounded = F.filter(F.col(features), lambda f: low.contains(F.lower(f)))
    return df.withColumns(
        {
            "signal_consistent": low.contains(F.lower(F.col(label))),
            "hallucinations": external,
            "hallucination_detected": F.size(external) > 0,
            "causal_claims": causal,
            "causal_claims_detected": F.size(causal) > 0,
            "features_grounded": grounded,
            "grounding_score": F.size(grounded).cast("double")
            / F.greatest(F.lit(1), F.size(F.col(features))),
        }
    )


def text_eval_rates(evaluated: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of texts per outcome in percent, and the mean grounding score."""
    rate = lambda c: F.avg(F.col(c).cast("int")) * 100.0
    return evaluated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rate("signal_consistent").alias("consistency_pct"),
        rate("hallucination_detected").alias("hallucination_pct"),
        rate("causal_claims_detected").alias("causal_pct"),
        F.avg("grounding_score").alias("grounding"),
    )


def conversation_records(df: DataFrame, turns_per_record: int | None = None) -> DataFrame:
    """``messages`` of each conversation in turn order, whole conversations by default.

    A record is one line of JSON and so one row, which Spark holds up to 2 GB.  With
    ``turns_per_record`` a conversation continues in further records (``part`` counts
    them); ``flatten_turns`` never gathers one at all.
    """
    part = F.lit(0).cast("long") if turns_per_record is None else F.floor(F.col("turn") / turns_per_record)
    turns = df.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns")
    )
    message = lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    return turns.select("conv_id", "part", F.transform("turns", message).alias("messages"))


def _marked(role: Column, content: Column) -> Column:
    """The ChatML marks around a message."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def flatten_chat(records: DataFrame) -> DataFrame:
    """One training text per record: every message between ChatML marks, in order."""
    texts = F.transform("messages", lambda m: _marked(m["role"], m["content"]))
    return records.withColumn("text", F.concat_ws("", texts)).drop("messages")


def flatten_turns(df: DataFrame) -> DataFrame:
    """The same texts turn by turn: rows in order of ``turn`` joined give the conversation's text.

    ``at`` is where a turn begins in that text.  A conversation of any length spreads over
    tasks: turns are numbered by ranges, and running lengths add up per range first.
    """
    turns = df.select("conv_id", "turn", _marked(F.col("role"), F.col("text")).alias("text"))
    sized = running_total(turns.withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long")), "size", ("conv_id",), ("turn",), "at")
    return sized.withColumn("at", F.col("at") - F.col("size")).drop("size")
