"""Ids that fill several chunks: null ids in a third of all rows, and one id in many rows."""

import random
from collections import Counter

import brute
import pytest

from tidemark.llm import substring


def documents(seed: int) -> list[tuple]:
    pick = random.Random(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(pick.randint(14, 30))) for k in range(25)]
    rows = []
    for i in range(360):
        kind = i % 6
        own = None if kind < 2 else 77 if kind == 2 else pick.choice([-4, 2**53 + 1, 500]) if kind == 3 else i
        fill = " ".join(f"u{pick.randint(0, 400)}" for _ in range(pick.randint(0, 20)))
        rows.append((own, " ".join([fill, *pick.sample(passages, pick.randint(0, 2))])))
    return rows + [(None, None), (77, ""), (77, "short one")]


def by_rows(docs):
    """Rows that share an id are one document; a null id is the smallest."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in docs:
        w = brute.words(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, key(d)), key(d))
    for d, t in docs:
        w, gone = brute.words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(d):
                gone.update(range(i, i + 13))
        yield d, len(w), len(gone), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("chunk_bytes", [700, 5_000, 8 << 20])
def test_substring_over_chunks(spark, chunk_bytes):
    docs = documents(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = substring.repeated_substrings(df, chunk_bytes=chunk_bytes).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in found)
    assert got == Counter(by_rows(docs))


def test_more_chunks_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKETS", 3)
    docs = documents(6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring.repeated_substrings(df, chunk_bytes=2_000).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in found)
    assert got == Counter(by_rows(docs))


def test_text_ids(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([("b", passage), ("a", passage), ("b", "x " + passage)], "doc_id string, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring.repeated_substrings(df, chunk_bytes=60).collect())
    assert got == [("a", 0), ("b", 15), ("b", 15)]
