"""Secret scanning over a ledger of content-addressed blobs.

Every version of a text is a blob, addressed by its SHA-256.  The ledger holds, per
blob, which rule versions have scanned it and what they found; a scan takes only
the pairs of blob and rule version that the ledger lacks, appends their findings,
and joins findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, whole
from tidemark.sources.storage import fresh_path

SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` has fewer than ``least`` code points are dropped.

    ``screen`` is a cheap pattern that any match must contain.
    """

    kind: str
    version: int
    pattern: str
    screen: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the base kinds and of further token formats.
RULES = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i)pass|secret|token|api", 2, 12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", "[0-9a-f]{16}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


def rule_spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as (rule, start, end) in code points.

    Matches and the stretches between them come from the same pattern, so running
    lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, rule.pattern, -1)
    sized = F.transform(
        F.arrays_zip(matches.alias("m"), tested.alias("t"), gaps.alias("g")),
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["t"]).alias("size")
        ),
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(F.lit(rule.key).alias("rule"), start.alias("start"), (start + x["len"]).alias("end"))
        keep = x["size"] >= rule.least if rule.least else F.lit(True)
        return F.struct(
            (start + x["len"]).alias("at"), F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    # The last stretch has no match after it.
    matched = F.filter(sized, lambda x: x["len"].isNotNull())
    return F.when(text.rlike(rule.screen), F.aggregate(matched, begin, add, lambda a: a["spans"])).otherwise(
        F.array().cast(SPANS)
    )


def scan_blobs(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """New ledger rows (blob, rules, findings) for unseen pairs of blob and rule version."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        fresh = versions.select("blob", "text").withColumn("rules", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        fresh = versions.select("blob", "text").join(seen, "blob", "left").select(
            "blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")
        )
    fresh = fresh.where(F.size("rules") > 0).dropDuplicates(["blob"])
    t = F.col("text")
    due = [F.when(F.array_contains("rules", r.key), rule_spans(t, r)).otherwise(F.array().cast(SPANS)) for r in rules]
    return fresh.select("blob", "rules", F.concat(*due).alias("findings"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier scans wrote there, or None before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def secret_scan(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
    ledger_path: str | None = None,
) -> DataFrame:
    """Per row: id, blob and findings, sorted by start and order of the rules.

    Earlier scans are read from ``ledger_path``, where this one appends its rows (a
    fresh shared folder if not given), and from ``ledger`` if there is a table of them
    elsewhere.  Pairs of blob and rule version found there are not scanned again, and
    a pair that two scans wrote side by side counts once.  Null text counts as empty
    and has no findings; whole texts of any length are scanned; repeated rows and
    texts each get the findings of their blob; equal starts are in order of the rules;
    an empty table gives no rows; other columns are not looked at.
    """
    spark = df.sparkSession
    t = whole(F.col(f"`{text}`"))
    versions = df.select(F.col(f"`{id}`").alias("id"), t.alias("text"), F.sha2(t, 256).alias("blob"))
    path = ledger_path or fresh_path(spark, "ledger")
    earlier = read_ledger(spark, path) if ledger_path else None
    seen = earlier if ledger is None else ledger if earlier is None else ledger.unionByName(earlier)
    new = scan_blobs(versions, rules, seen)
    new.write.mode("append").parquet(path)
    written = spark.read.schema(LEDGER).parquet(path)
    order = {r.key: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    known = written if ledger is None else ledger.unionByName(written)
    spans = F.flatten(F.collect_list("findings"))
    found = known.where(F.size("findings") > 0).groupBy("blob").agg((spans if seen is None else F.array_distinct(spans)).alias("f"))
    ranked = F.transform(
        F.filter("f", lambda x: F.element_at(rank, x["rule"]).isNotNull()),
        lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["rule"]).alias("rank"), x["end"].alias("end"), F.substring_index(x["rule"], "@", 1).alias("kind")),
    )
    found = found.select("blob", F.array_sort(ranked).alias("findings"))
    empty = F.array().cast(found.schema["findings"].dataType)
    return versions.select("id", "blob").join(found, "blob", "left").select(
        F.col("id").alias(id), "blob", F.coalesce("findings", empty).alias("findings")
    )


def spans_text(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    if kinds:
        findings = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text: str = "text", id: str = "doc_id", length: str | None = None, **kw) -> DataFrame:
    """``df`` with every secret replaced by its kind in brackets; all rows stay.

    ``length`` names a column with the text's code points that is kept in step.
    Null texts stay null.
    """
    hits = secret_scan(df, text, id, **kw).where(F.size("findings") > 0)
    hits = hits.select(F.col("blob").alias("__blob"), F.col("findings").alias("__f")).dropDuplicates(["__blob"])
    t = whole(F.col(f"`{text}`"))

    def add(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        out = F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("__f", begin, add, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    joined = df.withColumn("__sha", F.sha2(t, 256)).join(hits, F.col("__sha") == F.col("__blob"), "left")
    new = F.when(F.col("__f").isNotNull(), clean).otherwise(F.col(f"`{text}`"))
    out = joined.withColumn(text, new)
    if length:
        kept = F.col(f"`{length}`")
        fresh = F.length(F.col(f"`{text}`")).cast(df.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col("__f").isNotNull(), fresh).otherwise(kept))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
