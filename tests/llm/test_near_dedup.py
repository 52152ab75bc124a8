"""The pipeline's near dedup and quality stages where ids are null, shared or clash."""

import pytest

from tidemark.llm import simhash

DOCS = "doc_id long, text string"


def stays(spark, rows, parts=3):
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts))
    assert out.columns == ["doc_id", "text"]
    return sorted(((r.text or "")[:5], -1 if r.doc_id is None else r.doc_id) for r in out.collect())


def text(name, n=2000):
    return " ".join(f"{name}{i}" for i in range(n))


def test_null_and_shared_ids(spark):
    """Every row is judged for itself, whatever its id."""
    from tidemark.llm.quality import drop_rejected

    # 2,000 shingles and one more: at most two bits change.
    near = lambda name: text(name) + " end"
    for name in ("aaaa", "bbbb", "dddd", "eeee"):
        assert (simhash.fingerprint(text(name)) ^ simhash.fingerprint(near(name))).bit_count() <= 2
    good = [
        (None, text("aaaa")), (None, near("aaaa")), (7, text("bbbb")), (7, near("bbbb")), (7, text("cccc")),
        (8, text("dddd")), (None, near("dddd")), (9, text("eeee")), (3, near("eeee")), (None, text("ffff")),
        (5, text("gggg")), (5, text("gggg")),
    ]
    # Texts without words have one fingerprint and so are one class, like any other.
    got = stays(spark, good + [(None, ""), (None, None), (2**53 + 1, " ")])
    assert got == [(" ", 2**53 + 1), ("aaaa0", -1), ("bbbb0", 7), ("cccc0", 7), ("dddd0", 8), ("eeee0", 3), ("ffff0", -1), ("gggg0", 5)]

    bad = [(None, "too short"), (7, "short too"), (8, None)]
    df = spark.createDataFrame([(*r, "host") for r in good + bad], DOCS + ", source string").repartition(3)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, drop_rejected(df).select("doc_id", "text").collect()), key=key) == sorted(good, key=key)


def test_chains_and_empty(spark):
    """A class reaches along chains of links of two bits."""
    import brute

    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((100 - i, " ".join(words)))
        words = words[1:] + [f"n{i}"]
    want = sorted((t[:5], d) for (d, t), (_, _, first) in zip(rows, brute.simhash(rows)) if d == first)
    assert stays(spark, rows, 5) == want and len(want) < 60
    assert stays(spark, []) == []


@pytest.mark.parametrize("names", [["tag", "id", "fp", "component_id", "first", "tag_"]])
def test_clashing_names(spark, names):
    rows = [(1, "one two three four", *names), (2, "one two three four", *names), (3, "five six", *names)]
    df = spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
