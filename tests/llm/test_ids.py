"""Ids beyond 2^53, beside a null and repeated, come back as they are."""

import brute
import pytest

from tidemark.llm import exact_dedup, packing, simhash, substring, warc
from tidemark.llm import queries as q

BIG = 2**53
PASSAGE = " ".join(f"p{i}" for i in range(20))
TEXTS = [(None, "null " + PASSAGE), (BIG, "one " + PASSAGE), (BIG + 1, "two " + PASSAGE), (BIG + 3, "three"), (-BIG - 1, "four"), (BIG + 3, "three")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2)


def ids(rows):
    return sorted(((r.doc_id is None, r.doc_id) for r in rows), key=lambda x: (x[0], x[1] or 0))


WANT = sorted(((d is None, d) for d, _ in TEXTS), key=lambda x: (x[0], x[1] or 0))


def test_substring(docs):
    rows = substring.repeated_substrings(docs).collect()
    assert ids(rows) == WANT
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in rows}
    assert got == {d: tuple(rest) for d, *rest in brute.substring(TEXTS[:5])}
    assert got[BIG + 1][1] == 20 and got[BIG][1] == 20 and got[None][1] == 0


def test_packing(docs):
    assert ids(packing.pack_documents(docs, q.vocabulary(q.TOKENIZER)).collect()) == WANT


def test_exact_and_simhash(docs):
    assert ids(exact_dedup.exact_dedup(docs).collect()) == WANT
    assert ids(simhash.simhash_classes(docs).collect()) == WANT


def test_warc(spark):
    page = "x" * 200
    rows = [(BIG + 1, "http://a.com/1", page), (BIG + 2, "http://a.com/1", page), (10**18, "http://b.org", "y"), (None, None, None), (-5, "u", page + "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_index(df).collect()}
    assert got == {
        BIG + 1: ("response", None, 200), BIG + 2: ("revisit", BIG + 1, 200), 10**18: ("response", None, 1),
        None: ("response", None, 0), -5: ("response", None, 201),
    }
