"""Nulls, empty tables, repeated rows and clashing column names, for every operator."""

import pytest

from tidemark.llm import chat, exact_dedup, packing, pieces, quality, secrets, simhash, substring, urlfilter, warc
from tidemark.llm import queries as q

SCHEMA = "doc_id long, text string, source string, kept boolean, digest string, id long, fp long, url string"
LONG = "word " * 5000
ROWS = [
    (1, None, None, True, "x", 9, 9, None),
    (2, "", "a", None, None, None, None, "no host"),
    (2, "", "a", None, None, None, None, "no host"),
    (None, "some text of its own", "a", None, None, None, None, "http://a.example.net/en/x"),
    (3, LONG, "a", None, None, None, None, "http://EXAMPLE.net"),
    (4, LONG, None, None, None, None, None, "https://x.org/fr/1?q"),
]
OPERATORS = {
    "exact": exact_dedup.exact_dedup,
    "pack": lambda d: packing.pack_documents(d, q.vocabulary(q.TOKENIZER)),
    "chat": lambda d: chat.link_tool_calls(
        chat.turns_as_events(d.selectExpr("doc_id conv_id", "doc_id turn", "source role", "text")), q.CHAT_SCHEMAS
    ),
    "url": lambda d: urlfilter.filter_urls(d, q.URL_RULES, id="doc_id"),
    "quality": quality.quality,
    "substring": substring.repeated_substrings,
    "pieces": lambda d: pieces.round_trip(d, q.vocabulary(q.PIECE_MODEL)),
    "secrets": secrets.secret_scan,
    "simhash": simhash.simhash_classes,
    "warc": lambda d: warc.archive_and_index(d, html="text", id="doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeats(name, spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    n = OPERATORS[name](df).count()
    assert n == len(ROWS) if name != "pack" else n > len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(name, spark):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0
