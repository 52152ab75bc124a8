"""MinHash near-duplicates: universal hash minima, banding, verification, components.

A text's set of word shingles becomes 128 minima of universal hash functions.  Bands
of four minima deal equal sets into buckets; a pair at a Jaccard similarity of 0.8
misses all 32 bands once in twenty million times.  Links are confirmed on the full
sets, in two steps that list no pairs of a group:

* every member of a bucket is compared with one centre, the member that meets most
  others over all bands, so a group of near copies costs one comparison per copy;
* buckets whose members still lie in different classes are compared whole, in cells
  of bounded size: members outside the bucket's largest class against all members of
  other classes.  A cell hands on just the links that join classes, at most one less
  than it has members.

Pairs whose signatures agree too little to reach the similarity are not looked up.
Classes are components by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.llm.components import connected_components
from tidemark.sources.storage import stored

SEED = 12
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
BATCH = 1 << 16  # shingles hashed at a time
CELL = 256
#: Agreeing minima of 128 that a pair at 0.8 falls short of once in 10^8 times (102.4 less 5.6 deviations).
AGREE = 77
_rng = np.random.default_rng(SEED)
FACTOR = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64)
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        h = _mix(h ^ own[j : j + len(h)]) + np.uint64(j)
    return np.unique(h)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) upper halves of the least a * x + b of every set; sets must not be empty."""
    out = np.zeros((len(sets), MINIMA), np.uint32)
    if sets:
        x = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for i in range(MINIMA):
            out[:, i] = np.minimum.reduceat(x * FACTOR[i] + OFFSET[i], starts) >> np.uint64(32)
    return out



def signed_rows(df: DataFrame, text: str, id: str, k: int) -> DataFrame:
    """(id, digest, n, set_key, sig) per row: size, name and minima of its set; null sig without words."""
    kind = df.schema[id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text").cast(pa.binary()), 0
            sets: list[np.ndarray] = []
            held = 0
            for i in range(batch.num_rows):
                sets.append(shingle_set(texts[i].as_py(), k))
                held += len(sets[-1])
                if held >= BATCH or i + 1 == batch.num_rows:
                    worded = [s for s in sets if len(s)]
                    sigs = iter(minima(worded))
                    part = batch.slice(start, len(sets))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                            pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                        ],
                        ["id", "digest", "n", "set_key", "sig"],
                    )
                    start, sets, held = i + 1, [], 0

    t = whole(F.col(f"`{text}`"))
    source = df.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    return stored(source.mapInArrow(sign, f"id {kind}, digest binary, n long, set_key binary, sig binary"), "signed")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(k, set_key, n, sig, first, own): one row per distinct set; ``own`` names one document that holds it."""
    own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("own")
    sets = rows.where("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("id").alias("first"), own)
    return stored(sets.withColumn("k", F.monotonically_increasing_id()), "sets")


def shared_bands(sets: DataFrame) -> DataFrame:
    """(band, k, m) of the buckets that m > 1 sets fall into."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, BAND_ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(BAND_ROWS):
                key = _mix(key ^ sig[:, :, r].astype(np.uint64)) + np.uint64(r)
            k = np.repeat(batch.column("k").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(k)], ["band", "k"])

    visited = sets.select("k", "sig").mapInArrow(bands, "band long, k long").repartition("band")
    busy = visited.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return stored(visited.join(busy, "band"), "shared-bands")


def centre_pairs(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of members and the centre of one of their buckets whose signatures agree enough."""
    crowd = shared.groupBy("k").agg(F.sum("m").alias("crowd"))
    centre = F.max(F.struct("crowd", F.xxhash64("k").alias("h"), F.col("k").alias("c")))
    centres = shared.join(crowd, "k").groupBy("band").agg(centre.alias("c")).select("band", F.col("c.c").alias("b"))
    pairs = shared.join(centres, "band").where("k != b").select(F.col("k").alias("a"), "b").distinct()
    side = lambda x: sets.select(F.col("k").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((one == two).sum(1) >= AGREE)).select(["a", "b"])

    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(agreeing, "a long, b long"), "candidates")


def full_sets(df: DataFrame, sets: DataFrame, keys: DataFrame, text: str, id: str, k: int) -> DataFrame:
    """(k, s) with the sorted 64-bit hashes of every set in ``keys``, from one text that holds it."""
    wanted = sets.join(keys.select("k").distinct(), "k", "left_semi").select("k", F.col("own.id").alias("o_id"), F.col("own.digest").alias("o_digest"))
    t = whole(F.col(f"`{text}`"))
    texts = df.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    met = texts.join(wanted, F.col("digest").eqNullSafe(F.col("o_digest")) & F.col("id").eqNullSafe(F.col("o_id")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), k).tobytes() for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.binary())], ["k", "s"])

    # Rows repeated with the same id and text hold the set more than once.
    return stored(met.select("k", "text").mapInArrow(build, "k long, s binary").dropDuplicates(["k"]), "full-sets")


def linked(one: np.ndarray, two: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether of the union of two sorted sets the intersection has the share similarity[0] / similarity[1]."""
    if min(len(one), len(two)) * similarity[1] < similarity[0] * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return similarity[1] * both >= similarity[0] * (len(one) + len(two) - both)


def confirmed(pairs: DataFrame, full: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    side = lambda x: full.select(F.col("k").alias(x), F.col("s").alias(f"s_{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)]  # noqa: E731, B023
            keep = [linked(a, b, similarity) for a, b in zip(read("s_a"), read("s_b"))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long"), "confirmed")


def _cell_links(rows: dict, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join classes in one cell: its guests, each against all hosts of other classes."""
    ks, guest, minor = rows["k"], rows["guest"], rows["minor"]
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, MINIMA)
    names, root = np.unique(rows["root"], return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i in np.flatnonzero(guest).tolist():
        # Two minor members meet twice, once as host and once as guest.
        at = np.flatnonzero(~guest & (root != root[i]) & (~minor | (ks < ks[i])))
        agree = (sig[at] == sig[i]).sum(1)
        at, agree = at[agree >= AGREE], agree[agree >= AGREE]
        own = np.frombuffer(rows["s"][i], np.uint64)
        for j in at[np.argsort(-agree, kind="stable")].tolist():
            a, b = find(root[i]), find(root[j])
            if a != b and linked(own, np.frombuffer(rows["s"][j], np.uint64), similarity):
                parent[max(a, b)] = min(a, b)
                out.append((int(ks[i]), int(ks[j])))
    return out


def links_between_classes(
    shared: DataFrame, sets: DataFrame, classes: DataFrame, df: DataFrame, text: str, id: str, k: int, similarity: tuple[int, int]
) -> DataFrame:
    """(a, b) links between members of one bucket that lie in different classes (node, root)."""
    root = classes.select(F.col("node").alias("k"), "root")
    part = shared.where("m > 2").join(root, "k", "left").withColumn("root", F.coalesce("root", "k"))
    # A bucket's largest class is its major one; only the others' members go round.
    sizes = part.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    major = F.max(F.struct("c", "root")).alias("major")
    apart = sizes.groupBy("band").agg(major, F.count(F.lit(1)).alias("classes")).where("classes > 1").select("band", "major")
    member = part.join(apart, "band").withColumn("minor", F.col("root") != F.col("major.root"))
    blocks = lambda n: F.ceil(n / CELL)
    mixed = member.select(
        "band", "k", "root", "minor", blocks(F.col("m")).alias("hosts"), blocks(F.col("m") - F.col("major.c")).alias("guests")
    )
    mixed = stored(mixed, "mixed-bands")
    full = full_sets(df, sets, mixed, text, id, k)
    # A cell is a block of hosts (all members) and one of guests (minor members), CELL of each on average.
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("k", "band"), n)
    host = mixed.select("band", "k", "root", "minor", F.lit(False).alias("guest"), own(F.col("hosts")).alias("h"), each(F.col("guests")).alias("g"))
    guest = mixed.where("minor").select("band", "k", "root", "minor", F.lit(True).alias("guest"), own(F.col("guests")).alias("g"), each(F.col("hosts")).alias("h"))
    held = host.unionByName(guest).join(sets.select("k", "sig"), "k").join(full, "k")
    dealt = held.repartition("band", "h", "g").sortWithinPartitions("band", "h", "g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and len(rows["k"]) > 1:
                found = _cell_links({c: v if c in ("sig", "s") else np.array(v) for c, v in rows.items()}, similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            got = batch.to_pydict()
            for i, cell in enumerate(zip(got["band"], got["h"], got["g"])):
                if cell != now:
                    yield from done()
                    rows, now = {c: [] for c in ("k", "root", "minor", "guest", "sig", "s")}, cell
                for c in rows:
                    rows[c].append(got[c][i])
        yield from done()

    return stored(dealt.select("band", "h", "g", "k", "root", "minor", "guest", "sig", "s").mapInArrow(compare, "a long, b long"), "links")


def minhash_classes(
    df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 4, similarity: tuple[int, int] = (80, 100)
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links) and kept.

    Two rows are linked when 100 * intersection >= 80 * union of their sets of distinct
    k-word shingles, A-Z lower-cased; a text of fewer words is one shingle.  Null,
    empty and blank texts have no set and link to nothing: their component is their
    own id.  Rows repeated, and rows that share an id, are each judged for themselves;
    null ids are never the smallest, and a class of null ids alone has a null
    component.  ``kept`` says whether a row's id is its component's.  Texts are read
    whole, whatever their length; an empty table gives no rows; other columns are not
    looked at.
    """
    if similarity[0] * 100 < 80 * similarity[1]:
        raise ValueError("bands and signatures are laid out for similarities of 0.8 and more")
    rows = signed_rows(df, text, id, k)
    sets = distinct_sets(rows)
    shared = shared_bands(sets)
    pairs = centre_pairs(shared, sets)
    ends = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k")))
    links = confirmed(pairs, full_sets(df, sets, ends, text, id, k), similarity)
    classes = connected_components(links)
    more = links_between_classes(shared, sets, classes, df, text, id, k, similarity)
    # Class links instead of all links: a class is already known to hold together.
    found = connected_components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    root = sets.select("k", "set_key", "first").join(found.select(F.col("node").alias("k"), "root"), "k", "left")
    root = stored(root.select("set_key", "first", F.coalesce("root", "k").alias("root")), "roots")
    least = root.groupBy("root").agg(F.min("first").alias("least"))
    named = root.join(least, "root").select("set_key", "least")
    out = rows.where("n > 0").select("id", "n", "set_key").join(named, "set_key").select("id", "n", F.col("least").alias("component"))
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
