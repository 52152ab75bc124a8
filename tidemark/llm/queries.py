"""The operators as queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, hardneg, lexical, minhash, packing, pieces, quality, secrets, simhash, substring, urlfilter, warc
from tidemark.llm.common import table
from tidemark.llm.sql import ORACLES
from tidemark.sources.storage import stored

TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
# The rules of the url query.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# A transcript's calls: a prompt is needed, and turns count from zero.
CHAT_SCHEMAS = {"answer": (chat.Parameter("prompt", "string"), chat.Parameter("turn", "integer", least=0))}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packing.numbered(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER))), "pieces")
    places = packing.pack(pieces.select("item", "length"))
    sums = pieces.select("item", F.col("id").alias("doc_id"), "piece", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"))
    return sums.join(places, "item").drop("item")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(chat.turns_as_events(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("findings", lambda x: x["kind"])
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, secrets.BASE_KINDS),
        F.sha2(secrets.spans_text(F.col("findings"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text(F.col("findings")).alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_classes(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=F.col("id") % 50 == 0, label=moved)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_best_fit_packing, op3_tool_calls, op4_url_filter, op5_quality_rules,
    op6_substring_dedup, op7_piece_codec, op8_secret_scan, op9_simhash, op10_warc,
    op11_ranked_search, op12_minhash, op13_hard_negatives,
)}

__all__ = ["ORACLES", "QUERIES"]
