"""Ranked lexical search over per-term geometric blocks.

Documents are read once into a forward index: per document its length and the counts
of the terms that items ask for.  Each task then takes the documents in shards of
bounded size.  In a shard every posting list is cut into blocks of similar documents:
evenly spaced members of the list serve as centres, and each posting joins the centre
with the largest inner product of term contributions.  A block's summary is the
coordinatewise maximum of its documents' contributions, over the terms that some item
combines with the list's term; a bound is a summary's sum over an item's terms.
Blocks are opened from the highest bound down, documents are scored exactly from the
forward index, and the rest is skipped as soon as the next bound lies below the
lowest of the scores that stay.  All numbers are integers, so bounds are exact
and nothing that belongs into the result is skipped; an equal bound is opened,
since of equal scores the smaller id comes first.

Shards, lists and summaries live as long as the task: summaries alone are several
times as large as the texts, and building them is cheaper than storing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

BLOCK = 32  # postings to a centre
LONGEST = 64  # postings to a block
SHARD_BYTES = 64 << 20
BATCH_BYTES = 4 << 20  # of the texts of items searched together
SCALE = 1_000_000_000
# Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z change case.
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
_TABLE[0x30:0x3A] = b"0123456789"
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B] = b"abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(_TABLE)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Items:
    """A batch of items: their distinct terms, numbered, and which terms meet in some item."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        sets = [(tag, sorted(set(terms_of(text)))) for tag, text in rows]
        self.terms = sorted({t for _, s in sets for t in s})
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.asked = {tag: np.array([self.number[t] for t in s], np.int64) for tag, s in sets if s}
        beside: list[set[int]] = [set() for _ in self.terms]
        for own in self.asked.values():
            together = own.tolist()
            for t in together:
                beside[t].update(together)
        #: Of every term the terms that some item combines with it, itself included.
        self.beside = [np.array(sorted(s), np.int64) for s in beside]


class Shard:
    """The blocks of some documents' posting lists."""

    def __init__(self, items: Items, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int):
        self.values = np.zeros((n, len(items.terms)), np.int64)
        self.values[rows, terms] = values
        order = np.argsort(terms, kind="stable")
        bounds = np.searchsorted(terms[order], np.arange(len(items.terms) + 1))
        rows = rows[order]
        #: term -> (documents in blocks, start of every block, summary of every block)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for t in np.flatnonzero(np.diff(bounds)).tolist():
            self.lists[t] = self.blocks(rows[bounds[t] : bounds[t + 1]], items.beside[t])

    def blocks(self, docs: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.values[docs[:, None], beside]
        starts = np.zeros(1, np.int64)
        if len(docs) > BLOCK:
            like = found.astype(np.float32)
            like /= np.sqrt((like * like).sum(1, keepdims=True)) + np.float32(1e-9)
            nearest = (like @ like[::BLOCK].T).argmax(1)
            order = np.argsort(nearest, kind="stable")
            docs, found, nearest = docs[order], found[order], nearest[order]
            first = np.searchsorted(nearest, nearest)  # where the centre's postings start
            starts = np.flatnonzero((np.arange(len(docs)) - first) % LONGEST == 0)
        return docs, starts, np.maximum.reduceat(found, starts, axis=0)

    def search(self, items: Items, own: np.ndarray, top: Top) -> tuple[int, int]:
        """Adds the shard's best documents for the terms ``own`` to ``top``; (blocks, blocks opened)."""
        lists = [t for t in own.tolist() if t in self.lists]
        if not lists:
            return 0, 0
        bound = [self.lists[t][2][:, np.searchsorted(items.beside[t], own)].sum(1) for t in lists]
        of = np.repeat(np.arange(len(lists)), [len(b) for b in bound])
        block = np.concatenate([np.arange(len(b)) for b in bound])
        bound = np.concatenate(bound)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(self.values), bool)
        at, step = 0, 4
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= top.least:
            parts = []
            for i in order[at : at + step].tolist():
                if bound[i] >= top.least:
                    docs, starts, _ = self.lists[lists[of[i]]]
                    b = block[i]
                    parts.append(docs[starts[b] : starts[b + 1] if b + 1 < len(starts) else None])
            docs = np.unique(np.concatenate(parts))
            docs = docs[~seen[docs]]
            seen[docs] = True
            top.add(docs, self.values[docs[:, None], own].sum(1))
            at, step = min(at + step, len(order)), step * 2
        return len(order), at


class Top:
    """The k best (score, id) of one item so far; null ids come last among equals."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def names(self, ids: np.ndarray, null: np.ndarray) -> None:
        """Ids of the shard that ``add`` speaks of by place."""
        self.of_shard = ids, null

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least)
        if not good.any():
            return
        docs, (ids, null) = docs[good], self.of_shard
        scores = np.concatenate([self.scores, scores[good]])
        ids, null = np.concatenate([self.ids, ids[docs]]), np.concatenate([self.null, null[docs]])
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]
        self.least = int(self.scores[-1]) if len(best) == self.k else 0


def forward_index(df: DataFrame, items: Items, text: str, id: str) -> DataFrame:
    """(id, n, terms binary, counts binary) per row; n counts all terms of the whole text."""
    number = df.sparkSession.sparkContext.broadcast(items.number)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            n, terms, counts = [], [], []
            for x in batch.column("text").cast(pa.binary()):
                found = terms_of(x.as_py())
                asked = np.fromiter((known[t] for t in found if t in known), np.int32)
                own, many = np.unique(asked, return_counts=True)
                n.append(len(found))
                terms.append(own.tobytes())
                counts.append(many.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["id", "n", "terms", "counts"],
            )

    source = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(source.mapInArrow(index, "id long, n long, terms binary, counts binary"), "forward")


def weights(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the weight of each of the ``size`` terms asked for."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    n, total = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    for row in forward.select("terms").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def contributions(weight: np.ndarray, counts: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Score of each (term, count) in a text of ``length`` terms."""
    m = 10 + (90 * length * n) // total
    return weight * (SCALE * counts // (1000 * counts + 8 * m))


def search(forward: DataFrame, items: Items, n: int, total: int, weight: np.ndarray, k: int, shard_bytes: int) -> DataFrame:
    """(tag, id, score): of every task the k best documents of each item."""
    shared = forward.sparkSession.sparkContext.broadcast((items, weight))
    rows = max(16, shard_bytes // (8 * max(1, len(items.terms))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        tops = {tag: Top(k) for tag in items.asked}
        for batch in batches:
            batch = batch.filter(pa.array([len(x.as_py()) > 0 for x in batch.column("terms")], pa.bool_()))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                terms = [np.frombuffer(x.as_py(), np.int32) for x in part.column("terms")]
                counts = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in part.column("counts")]).astype(np.int64)
                of = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                terms = np.concatenate(terms).astype(np.int64)
                length = part.column("n").to_numpy()
                shard = Shard(items, of, terms, contributions(weight[terms], counts, length[of], n, total), part.num_rows)
                ids, null = part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
                for tag, own in items.asked.items():
                    tops[tag].names(ids, null)
                    shard.search(items, own, tops[tag])
        for tag, top in tops.items():
            if len(top.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.ids), tag, np.int64)), pa.array(top.ids, mask=top.null), pa.array(top.scores)], ["tag", "id", "score"]
                )

    return forward.select("id", "n", "terms", "counts").mapInArrow(best, "tag long, id long, score long")


def batches_of(items: DataFrame, batch_bytes: int) -> tuple[DataFrame, int]:
    """Items dealt into batches whose texts hold at most ``batch_bytes``, or a single item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // batch_bytes))
    while True:
        dealt = items.withColumn("batch", F.pmod(F.xxhash64("tag"), F.lit(n)))
        largest = dealt.groupBy("batch").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.max("b")).first()[0]
        if (largest or 0) <= 2 * batch_bytes:
            return dealt, n
        n *= 2


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    shard_bytes: int = SHARD_BYTES,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per item its ``k`` best documents with a score above 0 (all, if fewer): item_id, rank, id, score.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased, from whole texts of any length; null holds none.  An item's terms
    count once each; an item without terms, or whose terms no document holds, has no
    rows.  Equal scores come by ascending id, null ids last.  Rows of ``docs`` repeated
    are documents of their own, and so are items; an empty table gives no rows; other
    columns are not looked at.  Items are searched in batches of at most
    ``batch_bytes`` of text (a longer item alone), which is all that is broadcast.
    """
    asked = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    asked = stored(asked.withColumn("tag", F.monotonically_increasing_id()), "items")
    dealt, n_batches = batches_of(asked, batch_bytes)
    found = None
    for batch in range(n_batches):
        own = Items([(r.tag, bytes(r.t)) for r in dealt.where(F.col("batch") == batch).select("tag", F.coalesce("text", F.lit("")).cast("binary").alias("t")).collect()])
        forward = forward_index(docs, own, text, id)
        n, total, weight = weights(forward, len(own.terms))
        if n:
            part = stored(search(forward, own, n, total, weight, k, shard_bytes), "best")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "tag long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select("tag", "item"), "tag").select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")
