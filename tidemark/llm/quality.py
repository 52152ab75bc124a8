"""Quality rules judged per document and per host.

Each document gets counts and a verdict per rule.  Rule failures are added up by
host, the failure rates are shrunk towards the rate of all hosts with an
empirical beta prior (its strength follows from how much the hosts differ), and
hosts whose shrunk rate of a rule reaches ``host_rate`` become strict for it: their
documents that fail that rule go.  Everywhere else such a failure alone is not
enough, so a document that fails nothing always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, let, whole, words_of
from tidemark.sources.storage import stored

WINDOW = 8
# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SOFT_RULES = ("symbols", "repeats", "lines", "word_length")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose word sequence occurs twice or more in the text.

    Windows are compared by 64-bit hash.  Texts without two equal hashes, nearly
    all of them, are done after one pass; the others sort (hash, place) pairs.
    """

    def place_pairs(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated_places(s: Column) -> Column:
        def twin(v: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(s, j - 1)["h"] == v["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == v["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twin), lambda v: v["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                (a["n"] + p + window - F.greatest(a["end"], p)).alias("n"), (p + window).alias("end")
            ),
            lambda a: a["n"],
        )

    def of_hashes(h: Column) -> Column:
        slow = let(place_pairs(h), lambda s: covered(repeated_places(s)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    def of_words(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])
        )
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def document_counts(
    df: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", digest: bool = False
) -> DataFrame:
    """Counts per document: words, their code points, symbols, repeated lines and words."""
    t = F.col("text")
    base = df.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), whole(F.col(f"`{text}`")).alias("text")
    )
    blank = f"[^{BLANKS}]"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(blank))
    return base.select(
        "id",
        "host",
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        *[F.unhex(F.sha2(t, 256)).alias("digest")] * digest,
    ).select(*["digest"] * digest, "id", "host", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def failures() -> dict[str, Column]:
    """Soft rules: a failure counts against the host."""
    n = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "repeats": 100 * F.col("n_repeat_words") > 10 * n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


def host_verdicts(counted: DataFrame, host_rate: float = 0.5) -> DataFrame:
    """(host, strict_<rule>) for hosts that are strict for at least one rule.

    The prior of a rule has the mean of all documents and, by the method of
    moments, the strength p(1-p)/v - 1 for a variance v of the host rates about
    that mean, held between 1 and 1000; without variance it is 1000.
    """
    per_host = counted.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"fails_{r}")).alias(r) for r in SOFT_RULES]
    )
    rate = {r: F.col(r) / F.col("n") for r in SOFT_RULES}
    totals = per_host.agg(
        *[(F.sum(r) / F.sum("n")).alias(f"p_{r}") for r in SOFT_RULES],
        *[F.avg(rate[r]).alias(f"m_{r}") for r in SOFT_RULES],
        *[F.avg(rate[r] * rate[r]).alias(f"q_{r}") for r in SOFT_RULES],
    )
    prior = totals.select(
        *[f"p_{r}" for r in SOFT_RULES], *[_strength(f"p_{r}", f"m_{r}", f"q_{r}").alias(f"s_{r}") for r in SOFT_RULES]
    )
    strict = [
        ((F.col(r) + F.col(f"prior.p_{r}") * F.col(f"prior.s_{r}")) / (F.col("n") + F.col(f"prior.s_{r}")) >= host_rate).alias(f"strict_{r}")
        for r in SOFT_RULES
    ]
    judged = per_host.withColumn("prior", prior.select(F.struct("*")).scalar()).select("host", *strict)
    return judged.where(F.greatest(*[F.col(f"strict_{r}") for r in SOFT_RULES]))


def _strength(p: str, m: str, q: str) -> Column:
    p_, m_, q_ = F.col(p), F.col(m), F.col(q)
    v = q_ - 2 * p_ * m_ + p_ * p_
    s = F.try_divide(p_ * (1 - p_), v) - 1
    return F.when(v > 1e-12, F.least(F.greatest(s, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)


def judged(df: DataFrame, text: str, id: str, host: str, host_rate: float, digest: bool = False) -> DataFrame:
    """Per row: id, host, counts, base_failed and kept; ``digest`` adds the text's SHA-256."""
    n = F.col("n_words")
    counted = document_counts(df, text, id, host, digest)
    counted = counted.withColumns({f"fails_{r}": c for r, c in failures().items()}).withColumn(
        "base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    )
    counted = stored(counted, "quality")
    hosts = host_verdicts(counted, host_rate).withColumnRenamed("host", "__host")
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
    struck = F.greatest(*[F.col(f"fails_{r}") & F.coalesce(F.col(f"strict_{r}"), F.lit(False)) for r in SOFT_RULES])
    return joined.withColumn("kept", ~F.col("base_failed") & ~struck)


def quality(
    df: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", host_rate: float = 0.5
) -> DataFrame:
    """Per row: id, counts, base_failed and kept.

    Null text has no words and fails; a null host is a host of its own; empty
    tables give no rows; repeated rows are judged one by one; other columns are
    not looked at.  The counts are written once, since the host rates and the
    verdict both read them.
    """
    return judged(df, text, id, host, host_rate).select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def drop_rejected(
    df: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", host_rate: float = 0.5
) -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns.

    The verdict follows from text and host, so rows are matched by both and by id
    (which deals copies of one text out); rows that share an id, null or not, do not
    share a verdict.
    """
    rejected = judged(df, text, id, host, host_rate, digest=True).where(~F.col("kept"))
    rejected = rejected.select(F.col("id").alias("__id"), F.col("host").alias("__host"), F.col("digest").alias("__digest")).distinct()
    same = (
        F.col(f"`{id}`").eqNullSafe(F.col("__id"))
        & F.col(f"`{host}`").cast("string").eqNullSafe(F.col("__host"))
        & (F.unhex(F.sha2(whole(F.col(f"`{text}`")), 256)) == F.col("__digest"))
    )
    return df.join(rejected, same, "left_anti")
