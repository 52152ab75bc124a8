"""Substring deduplication by prefix-partitioned suffix trees.

Documents are range-partitioned by id, and rows that share an id by their place, into
chunks, one stored file each.  Every word position starts a suffix; cut at the window's length, a suffix is a leaf path
of a tree whose first edge is a prefix of it.  Suffixes are split into groups by
prefixes of variable length: short ones where a group stays small, longer ones where
a frequent beginning would not.  A group's tree is its suffixes in order, a deep
internal node a run of suffixes equal over the whole window, and its first leaf the
one where the sequence starts first.  A chunk hands in each distinct suffix once, so
a passage in a third of all documents costs one entry per chunk, and gets back one
bit per suffix: whether a chunk of smaller ids has it.  Within a chunk the earliest
document is found locally.

Chunks are ordered by a rank of their ids.  An id that fills several chunks, as a
null id may, has a rank of its own between its first chunk's and the next one's, so
that its chunks do not count as earlier than one another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.sources.storage import fresh_path, stored

WINDOW = 13
PREFIXES = (1, 5)  # words of a short and of a long prefix; the third length is the window
CELLS = 1 << 12
BUCKETS = 1 << 14  # files of more chunks than this share buckets
FREQUENT = 8  # a prefix cell this many times as full as the mean group goes on to the next length
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _block_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of every word: a polynomial in its bytes, from running sums over the block."""
    whole = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    blank = _IS_BLANK[whole]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = turn[0::2], turn[1::2]
    total = np.cumsum((whole + np.uint64(1)) * _powers(_MULTIPLIER, len(whole)), dtype=np.uint64)
    h = (total[end - 1] - total[start - 1]) * _powers(_INVERSE, len(whole))[start]
    h = mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(start, ends)[:-1])


def word_hashes(texts: list[str | None], block: int = 1 << 20) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in blocks of about ``block`` bytes."""
    out, held, size = [], [], 0
    for t in texts:
        raw = t.encode() if t else b""
        held.append(raw)
        size += len(raw) + 1
        if size >= block:
            out.extend(_block_hashes(held))
            held, size = [], 0
    return out + _block_hashes(held) if held else out


def prefix_hashes(words: list[np.ndarray], lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per length, hashes of that many words from each place with a whole window after it,
    over all documents in a row; and the index of the document of each place."""
    size = np.array([len(x) for x in words], np.int64)
    h = np.concatenate(words) if words else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words)), size)
    m = max(len(h) - WINDOW + 1, 0)
    full = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :]) if m else np.zeros(0, np.int64)
    out, found = np.zeros(m, np.uint64), []
    for k in range(max(lengths)):
        out *= _MULTIPLIER
        out += h[k : k + m]
        if k + 1 in lengths:
            found.append(mixed(out[full]))
    return found, doc[full]


def _suffixes(words: list[np.ndarray], cell_level: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(group, suffix hash, document index) of every window of the chunk."""
    (short, middle, suffix), doc = prefix_hashes(words, (*PREFIXES, WINDOW))
    level = cell_level[(short % np.uint64(CELLS)).astype(np.int64)]
    key = np.where(level == 0, short, np.where(level == 1, middle, suffix))
    return (mixed(key + _MULTIPLIER) % np.uint64(groups)).astype(np.int64), suffix, doc


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def store_chunks(df: DataFrame, text: str, id: str, chunks: int) -> DataFrame:
    """(chunk, id, own, none, text), each chunk a range of (id, place) in a file of its own."""
    spark = df.sparkSession
    key = F.col(f"`{id}`")
    # A filled id and a mark: pandas would make doubles of long ids beside nulls.
    filled = F.coalesce(key, F.lit(0).cast(df.schema[id].dataType))
    rows = df.select(key.alias("id"), filled.alias("own"), key.isNull().alias("none"), F.col(f"`{text}`").cast("string").alias("text"))
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(chunks, "id", "place").drop("place").withColumn("chunk", F.spark_partition_id())
    path = fresh_path(spark, "chunks")
    name = "chunks_" + path.rsplit("-", 1)[-1]
    writer = ranged.write.bucketBy(min(chunks, BUCKETS), "chunk").option("path", path).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def ranked(table: DataFrame) -> DataFrame:
    """Add ``rank``: 2 * chunk + 1, but one number for all rows of an id that several chunks
    hold: 2 * first chunk + 2.  Such an id is an end of every chunk it is in."""
    key = F.struct((~F.col("none")).alias("known"), "own")  # null ids come first
    ends = stored(table.groupBy("chunk").agg(F.min(key).alias("low"), F.max(key).alias("high")), "ends")
    held = ends.select("chunk", F.explode(F.array("low", "high")).alias("key")).groupBy("key")
    spread = held.agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    low, high = (spread.select(F.col("key").alias(end), F.col("first").alias(f"first_{end}")) for end in ("low", "high"))
    known = ends.join(low, "low", "left").join(high, "high", "left")
    first = F.when(key == F.col("low"), F.col("first_low")).when(key == F.col("high"), F.col("first_high"))
    rank = F.coalesce(first * 2 + 2, F.col("chunk") * 2 + 1).cast("long")
    return table.join(known, "chunk").withColumn("rank", rank).drop(*known.drop("chunk").columns)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, np.ndarray]]:
    """Whole chunks (chunk, texts, ranks) of a partition whose rows are sorted by chunk."""
    chunk, texts, ranks = None, [], []
    for pdf in batches:
        for c, part in pdf.groupby("chunk", sort=False):
            if c != chunk and texts:
                yield chunk, texts, np.array(ranks, np.int64)
                texts, ranks = [], []
            chunk = c
            texts.extend(part["text"].tolist())
            ranks.extend(part["rank"].tolist())
    if texts:
        yield chunk, texts, np.array(ranks, np.int64)


def _leaves(group: np.ndarray, suffix: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by (group, suffix), where each run of equal ones begins, the runs
    in the order in which they are handed in, (group, rank, suffix), and where a row of that
    begins.  Windows must come by rank: a run then counts at its smallest."""
    order = np.lexsort([suffix, group])
    g, s = group[order], suffix[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]) if len(g) else np.zeros(0, bool)
    g, r = g[new], rank[order][new]
    handed = np.arange(len(g)) if len(g) == 0 or r.min() == r.max() else np.lexsort([r, g])
    g, r = g[handed], r[handed]
    row = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])) if len(g) else np.zeros(0, np.int64)
    return order, new, handed, row


def prefix_levels(stored_chunks: DataFrame, groups: int) -> np.ndarray:
    """Which prefix length each cell of first words needs: a fixed number of counters."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for pdf in batches:
            (short,), _ = prefix_hashes(word_hashes(pdf["text"].tolist()), PREFIXES[:1])
            total += np.bincount((short % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield pd.DataFrame({"cell": np.arange(CELLS), "n": total})

    found = stored_chunks.select("text").mapInPandas(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    n = np.zeros(CELLS, np.int64)
    for row in found.collect():  # CELLS rows, whatever the input
        n[row["cell"]] = row["n"]
    full = n > FREQUENT * max(1, n.sum() // max(groups, CELLS))
    return np.where(full, np.where(n > n.sum() // 64, 2, 1), 0)


def repeated_substrings(df: DataFrame, text: str = "text", id: str = "doc_id", chunk_bytes: int = 8 << 20, group_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (text of the words left) and removed spans.

    Removed is every word covered by a window of 13 words whose word sequence also
    starts in a document with a smaller id; windows are judged on the input.  Spans
    are (start, end) in words.  Null and empty texts have no words; a null id is
    smaller than any other, and rows that share an id are one document for the
    comparison, however many chunks they fill; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    groups = max(partitions(spark), -(-size // group_bytes))
    table = store_chunks(df, text, id, chunks)
    levels = prefix_levels(table, groups)
    rows = ranked(table)

    def hand_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, texts, ranks in _gathered(batches):
            group, suffix, doc = _suffixes(word_hashes(texts), levels, groups)
            order, new, handed, row = _leaves(group, suffix, ranks[doc])
            first = order[new][handed]
            found = [
                (int(group[x[0]]), int(chunk), int(ranks[doc[x[0]]]), _packed(suffix[x]))
                for x in (np.split(first, row[1:]) if len(row) else [])
            ]
            yield pd.DataFrame(found, columns=["g", "chunk", "rank", "suffixes"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        parts = [_unpacked(x) for x in pdf["suffixes"]]
        suffix = np.concatenate(parts)
        size = [len(x) for x in parts]
        rank = np.repeat(pdf["rank"].to_numpy(), size)
        # Leaves in order of suffix, then of rank: the first leaf of a run is the earliest.
        order = np.argsort(suffix, kind="stable")
        rank, deep = rank[order], np.concatenate([[False], suffix[order][1:] == suffix[order][:-1]])
        later = np.zeros(len(suffix), bool)
        later[order] = rank > rank[~deep][np.cumsum(~deep) - 1]
        bits = [zlib.compress(np.packbits(x).tobytes(), 1) for x in np.split(later, np.cumsum(size)[:-1])]
        return pd.DataFrame({"g": pdf["g"], "chunk": pdf["chunk"], "rank": pdf["rank"], "bits": bits})

    sorted_rows = rows.select("chunk", "rank", "text").sortWithinPartitions("chunk", "rank")
    handed_in = sorted_rows.mapInPandas(hand_in, "g int, chunk int, rank long, suffixes binary")
    answers = handed_in.groupBy("g").applyInPandas(answer, "g int, chunk int, rank long, bits binary")

    kind = df.schema[id].dataType.simpleString()

    def finish(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "own"], ascending=[False, True], kind="stable")
        texts = rows["text"].tolist()
        words = word_hashes(texts)
        group, suffix, doc = _suffixes(words, levels, groups)
        order, new, handed, row = _leaves(group, suffix, rows["rank"].to_numpy()[doc])
        first = order[new][handed]
        replies = {(x, r): b for x, r, b in zip(bits["g"], bits["rank"], bits["bits"])}
        later = np.zeros(len(first), bool)
        for at, n in zip(row, np.diff(np.append(row, len(first)))):
            reply = replies[group[first[at]], rows["rank"].iat[doc[first[at]]]]
            later[handed[at : at + n]] = np.unpackbits(np.frombuffer(zlib.decompress(reply), np.uint8))[:n]
        d, run = doc[order], np.cumsum(new) - 1
        earlier = later[run] if len(first) else new
        # Documents of the chunk in order of id; rows that share an id count as one.
        same, null = rows["own"].to_numpy(), rows["none"].to_numpy()
        rank = np.cumsum(np.concatenate([[0], (same[1:] != same[:-1]) | (null[1:] != null[:-1])])) if len(rows) else same
        rank = rank.astype(np.int64)
        repeated = np.zeros(len(order), bool)
        repeated[order] = earlier | (rank[d] > rank[d[new]][run]) if len(order) else earlier
        ids = [None if n else k for k, n in zip(same.tolist(), null.tolist())]
        out, at = [], 0
        for key_, t, h in zip(ids, texts, words):
            m = max(len(h) - WINDOW + 1, 0)
            starts = np.flatnonzero(repeated[at : at + m])
            at += m
            w = t.encode().split() if t else []
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            kept = b" ".join([x for x, no in zip(w, gone.tolist()) if not no]).decode()
            out.append((key_, len(h), int(gone.sum()), kept, spans))
        result = pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept", "removed"])
        result["id"] = pd.Series([x[0] for x in out], dtype=object)
        return result

    schema = f"id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"
    done = rows.drop("id").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, schema)
    return done.withColumnRenamed("id", id)


