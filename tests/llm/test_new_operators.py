"""Ranked search, MinHash classes and hard negatives against brute force on hard cases."""

import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, lexical, minhash

BIG = 2**53
DOCS = "doc_id long, text string, rank int, score long, k long, source string"


def docs_frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 7, 7, 7, "x") for r in rows], DOCS).repartition(parts)


# Ranked search ------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text or ""))


def ranked(docs, items, k=10):
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    out = []
    for item, text in items:
        own = set(terms(text))
        df = {t: sum(t in w for _, w in split) for t in own}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scores = []
        for d, w in split:
            m = 10 + 90 * len(w) * n // total
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in own if t in w)
            if s > 0:
                scores.append((-s, d is None, d))
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(best)]
    return out


ITEMS = "item_id long, text string, rank int, doc_id long, tag long, batch int"


def search(spark, docs, items, **kw):
    frame = spark.createDataFrame([(*i, 1, 2, 3, 4) for i in items], ITEMS)
    found = lexical.ranked_search(docs_frame(spark, docs), frame, **kw).select("item_id", "rank", "doc_id", "score")
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, found.collect()), key=key)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["ÉÀ", "été", "x1"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([10, 40, 123])]) + rng.choice(["", ".", ",Z"]) for _ in range(n))
    docs = [(BIG + i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1, docs[0][1]), (None, docs[0][1]), (2, None), (3, ""), (4, " .,;"), (5, "w1 " * 30_000), (BIG + 3, "w5 W5"), (BIG + 3, "w5 W5")]
    items = [(i, text(rng.randrange(1, 9))) for i in range(20)] + [(50, None), (51, "?!"), (52, "unknown"), (None, "w3 w4 ÉÀ"), (7, "w7")]
    return docs, items


def test_ranked_search_equals_brute_force(spark, library):
    docs, items = library
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(ranked(docs, items), key=key)
    assert search(spark, docs, items) == want
    # Shards of 16 documents and batches of few items change nothing.
    assert search(spark, docs, items, shard_bytes=1, batch_bytes=200) == want
    assert search(spark, [], items) == [] and search(spark, docs, []) == []


def test_blocks_are_skipped_and_bounds_hold():
    """Two kinds of texts: an item of one kind leaves most blocks of the other closed."""
    rng = np.random.default_rng(1)
    items = lexical.Items([(0, b"a0 a1 a2 common"), (1, b"b0 b1 common")])
    n = 2000
    kind = np.arange(n) % 2
    values = np.zeros((n, len(items.terms)), np.int64)
    for t, name in enumerate(items.terms):
        own = {ord("a"): kind == 0, ord("b"): kind == 1, ord("c"): np.ones(n, bool)}[name[0]]
        values[:, t] = np.where(own & (rng.random(n) < 0.8), rng.integers(1, 1000, n), 0)
    rows, terms = np.nonzero(values)
    shard = lexical.Shard(items, rows, terms, values[rows, terms], n)
    for t, (docs, starts, summary) in shard.lists.items():
        assert sorted(docs) == np.flatnonzero(values[:, t]).tolist()
        for b, start in enumerate(starts):
            part = docs[start : starts[b + 1] if b + 1 < len(starts) else None]
            assert 0 < len(part) <= lexical.LONGEST
            assert (summary[b] == values[part][:, items.beside[t]].max(0)).all()
    top = lexical.Top(10)
    top.names(np.arange(n), np.zeros(n, bool))
    blocks, opened = shard.search(items, items.asked[0], top)
    scores = values[:, items.asked[0]].sum(1)
    want = np.lexsort((np.arange(n), -scores))[:10]
    assert top.ids.tolist() == want.tolist() and top.scores.tolist() == scores[want].tolist()
    assert opened < 0.7 * blocks


# MinHash ------------------------------------------------------------------------


def minhash_want(docs, k=4):
    grams = []
    for _, t in docs:
        w = brute.words(brute.lower(t or ""))
        grams.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = []
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    roots = brute.joined(len(docs), links)
    least = {}
    for (d, _), r in zip(docs, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(g), least.get(r), d == least.get(r)) for (d, _), g, r in zip(docs, grams, roots)]


def by_null(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def minhash_got(spark, docs):
    return by_null(minhash.minhash_classes(docs_frame(spark, docs)).collect())


def edited(rng, words, share, name):
    return [f"{name}{i}" if rng.random() < share else w for i, w in enumerate(words)]


@pytest.mark.parametrize("cell", [256, 8])
def test_minhash_equals_brute_force(cell, spark, monkeypatch):
    """Chains, a hot group of near copies around 0.8, exact copies, nulls, and ids beyond 2^53."""
    monkeypatch.setattr(minhash, "CELL", cell)
    rng = random.Random(5)
    origin = [f"o{i}" for i in range(300)]
    docs = [(BIG + i, " ".join(edited(rng, origin, rng.choice([0.01, 0.02, 0.03, 0.05]), f"e{i}x"))) for i in range(150)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(6):
        chain = chain[5:] + [f"c{i}n{j}" for j in range(5)]
        docs.append((900 - i, " ".join(chain).upper()))
    docs += [(i, " ".join(f"u{i}w{j}" for j in range(rng.randrange(1, 80)))) for i in range(60)]
    docs += [(100 + i, "Same Text of\tsix plain\nwords") for i in range(20)] + [(None, "same text of six plain words")]
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, None), (203, "two words"), (204, "Two  words"), (205, "two"), (BIG + 1, "two words")]
    docs += [(300, "word " * 40_000), (301, "word " * 20_000)]
    assert minhash_got(spark, docs) == by_null(minhash_want(docs))


def test_minhash_empty(spark):
    assert minhash_got(spark, []) == []
    assert minhash_got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_minhash_bounds():
    """A pair at 0.8 exactly: how often no band or too few minima agree."""
    p = 0.8
    assert (1 - p**minhash.BAND_ROWS) ** minhash.BANDS < 1e-7
    few = sum(math.comb(minhash.MINIMA, i) * p**i * (1 - p) ** (minhash.MINIMA - i) for i in range(minhash.AGREE))
    assert few < 1e-7
    with pytest.raises(ValueError):
        minhash.minhash_classes(None, similarity=(79, 100))


# Hard negatives -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, rank int, tag long, q string"


def negatives_want(rows, every=4):
    use = [
        (v, [math.floor(256 * x) for x in e], y)
        for v, e, y in rows
        if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (a, ea, ya) in enumerate(use):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(ea, e)), v, y) for j, (v, e, y) in enumerate(use) if j != i]
        for s, p, _ in sorted((x for x in scored if x[2] == ya), key=order)[:5]:
            fit = [x for x in scored if x[2] != ya and 50 * s <= 100 * x[0] <= 95 * s]
            out += [(a, p, r + 1, v, s, n) for r, (n, v, _) in enumerate(sorted(fit, key=order)[:3])]
    return out


def negatives_got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], VECTORS).repartition(3)
    return by_null(hardneg.hard_negatives(df, anchor=F.col("id") % 4 == 0, **kw).collect())


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e-9])
def test_hard_negatives_equal_brute_force(scale, spark):
    """Small, wide (beyond a machine word's fields) and all but equal components."""
    rng = random.Random(8)
    rows = [(BIG + i, [rng.gauss(0.3, 0.5) * scale for _ in range(16)], rng.randrange(3)) for i in range(120)]
    rows += [(1, [0.5 * scale] * 16, 1), (4, None, 1), (8, [0.1] * 16, None), (12, [None, 1.0], 1), (16, [float("nan")], 2), (20, [float("inf")], 0)]
    rows += [(24, [], 1), (28, [0.25 * scale] * 3, 2), (None, [0.4 * scale] * 16, 2), (32, [0.5 * scale] * 16, 0), (32, [0.5 * scale] * 16, 0)]
    want = by_null(negatives_want(rows))
    assert len(want) > 20 or scale < 1
    assert negatives_got(spark, rows) == want
    assert negatives_got(spark, rows, anchor_block=7, row_block=11) == want


def test_hard_negatives_edges(spark):
    assert negatives_got(spark, []) == []
    assert negatives_got(spark, [(4, [1.0], 0), (5, [1.0], 0)]) == []
    with pytest.raises(ValueError):
        negatives_got(spark, [(4, [1e12] * 3, 0), (5, [1e12] * 3, 0)])


def test_packed_products_are_exact():
    rng = np.random.default_rng(4)
    for top in (0, 1, 200, 2**20, 2**27):
        a, q = rng.integers(-top, top + 1, (9, 33)), rng.integers(-top, top + 1, (50, 33))
        width = hardneg.field_width(33, top, top)
        assert (hardneg.products(a, q, top, top, width) == a @ q.T).all()
    with pytest.raises(ValueError):
        hardneg.field_width(64, 2**31, 2**31)
