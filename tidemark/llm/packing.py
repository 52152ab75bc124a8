"""Best-fit packing of token pieces into fixed-length sequences.

Pieces are dealt into groups of bounded size and packed best-fit, longest first, in
each group.  Bins at least ``nearly_full`` are emitted; the others become the items
of the next round, dealt anew into fewer groups, until one group is left or a round
merges less than one item a group.  Best fit leaves at most one bin of a group half
empty, and two fuller ones never fit together, so what such an end gives away is at
most one sequence per group of ``GROUP_ITEMS`` items.  Only (item, length) pairs move in the rounds; token ids stay
where they were written until their places are known, and then move once.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

CAPACITY = 2048
GROUP_ITEMS = 50_000
CACHED_WORDS = 1 << 19
# Fixed value: a token that is matched before anything else, so it keeps its neighbours apart.
SEPARATOR = "<|endoftext|>"


# ASCII punctuation without the apostrophe of contractions and the signs of special tokens.
MARKS = b".,#$%&*;:!?()"
SHORT = 16  # bytes of a word that two machine words hold
KIND = np.full(256, 3, np.int8)  # 0 white space, 1 ASCII letter, 2 mark, 3 anything else
KIND[list(b" \t\n\x0b\x0c\r")] = 0
KIND[97:123] = 1
KIND[list(MARKS)] = 2
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BATCH_BYTES = 1 << 20


def hashed(key: np.ndarray) -> np.ndarray:
    h = (key[:, 0] ^ (key[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the place of one of each, and which of them every row is."""
    _, where, which = np.unique(hashed(key), return_index=True, return_inverse=True)
    if (key[where][which] != key).any():  # two words with one hash
        _, where, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
    return key[where], where, which.ravel()


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins across white space.

    Its pre-tokenizer drops white space and keeps every match apart, so a text's ids
    are those of its words in a row.  Words repeat far more often than texts: each is
    encoded once and looked up afterwards, up to ``SHORT`` bytes by its bytes as two
    machine words in an open hash table, longer ones in a dictionary.  A text is cut
    at ASCII white space and between ASCII letters and ``MARKS``, where a match of the
    pre-tokenizer always ends.  The memory starts over when it is full.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << (4 * self.cached - 1).bit_length()
        self.key = np.zeros((self.slots, 2), np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.probes = 1
        self.long: dict[bytes, int] = {}
        #: Entry 0 is a document's end.
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words; many share a text, held apart by a token of the vocabulary."""
        texts = [SEPARATOR.join(words[at : at + 20]) for at in range(0, len(words), 20)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable((*e.ids, self.separator) for e in found), np.uint32)
        ends = np.flatnonzero(ids == self.separator)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.separator]

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Entries of new words, which hold no part of a special token."""
        lengths, ids = self._ids([w.decode() for w in words])
        first = len(self.lengths)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        return np.arange(first, len(self.lengths), dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (hashed(key) & np.uint64(self.slots - 1)).astype(np.int64)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Entry of every key, -1 if new."""
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for probe in range(self.probes):
            at = (slot[left] + probe) & (self.slots - 1)
            same = (self.key[at] == key[left]).all(1) & (self.entry[at] >= 0)
            out[left[same]] = self.entry[at[same]]
            left = left[~same & (self.entry[at] >= 0)]
            if not len(left):
                break
        return out

    def insert(self, key: np.ndarray, entry: np.ndarray) -> None:
        slot, left, probe = self._slot(key), np.arange(len(key)), 0
        while len(left):
            at = (slot[left] + probe) & (self.slots - 1)
            _, first = np.unique(at, return_index=True)
            first = first[self.entry[at[first]] < 0]
            self.key[at[first]], self.entry[at[first]] = key[left[first]], entry[left[first]]
            left = np.delete(left, first)
            probe += 1
        self.probes = max(self.probes, probe)

    def entries(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, entry) of the words of a lower-cased text."""
        kind = KIND[np.frombuffer(text, np.uint8)]
        # A word ends at white space (product 0) and between a letter and a mark (product 2).
        edge = kind[1:] * kind[:-1]
        edge = np.concatenate([[True], (edge == 0) | (edge == 2), [True]])
        starts = np.flatnonzero((kind != 0) & edge[:-1])
        size = np.flatnonzero((kind != 0) & edge[1:]) + 1 - starts
        padded = np.frombuffer(text + bytes(SHORT), np.uint8)
        words = np.ndarray(len(text) + SHORT - 7, "<u8", padded, strides=(1,))
        short = np.flatnonzero(size <= SHORT)
        key = np.empty((len(short), 2), np.uint64)
        for i in (0, 1):
            key[:, i] = words[starts[short] + 8 * i] & LOW_BYTES[np.clip(size[short] - 8 * i, 0, 8)]
        found = np.empty(len(starts), np.int32)
        found[short] = self.look_up(key)
        long = np.flatnonzero(size > SHORT)
        spelled = [text[a : a + n] for a, n in zip(starts[long].tolist(), size[long].tolist())]
        found[long] = [self.long.get(w, -1) for w in spelled]
        new = short[found[short] < 0]
        fresh_long = list({w for w, e in zip(spelled, found[long].tolist()) if e < 0})
        if len(new):
            keys, where, which = distinct(key[found[short] < 0])
            shown = new[where]
            entry = self.learn([text[a : a + n] for a, n in zip(starts[shown].tolist(), size[shown].tolist())])
            if len(self.lengths) <= self.cached:
                self.insert(keys, entry)
            found[new] = entry[which]
        if fresh_long:
            entry = dict(zip(fresh_long, self.learn(fresh_long).tolist()))
            self.long.update(entry)
            found[long] = [self.long[w] for w in spelled]
        return starts, found

    def _whole(self, text: bytes) -> np.ndarray:
        """Ids of a text that may hold a special token, word by word as it stands."""
        found = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in text.split()]
        return np.array(list(itertools.chain.from_iterable(found)), np.uint32)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): every text's ids and id 0, one after another."""
        if len(self.lengths) > self.cached:
            self.clear()
        odd = {i for i, t in enumerate(texts) if t and b"<|" in t}
        plain = [b"" if i in odd else (t or b"").lower() for i, t in enumerate(texts)]
        ends = np.cumsum([len(t) + 1 for t in plain])
        starts, entry = self.entries(b"\n".join(plain) + b"\n")
        upto = np.searchsorted(starts, ends)
        entry = np.insert(entry, upto, 0)
        n = self.lengths[entry]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[entry] - stop + n, n) + np.arange(int(stop[-1]))]
        bounds = stop[upto + np.arange(len(texts))]
        if odd:
            parts = np.split(ids, bounds[:-1])
            for i in odd:
                parts[i] = np.append(self._whole(texts[i]), np.uint32(0))
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(bounds, prepend=0)


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length and ids.

    A document is its ids followed by id 0; null and empty texts are that id alone.
    Only documents longer than ``capacity`` are cut; just their last piece may be
    shorter.  Texts are encoded whole, in batches of about ``BATCH_BYTES``.
    """

    def pieces(rows: pa.RecordBatch, encoder: WordTokenizer) -> pa.RecordBatch:
        ids, lengths = encoder.encode(rows.column("text").cast(pa.binary()).to_pylist())
        many = -(-lengths // capacity)
        of = np.repeat(np.arange(len(lengths)), many)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(lengths[of] - start, capacity)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        data = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
        columns = [rows.column("id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
                yield pieces(batch.slice(at, stop - at), encoder)
                at = stop

    kind = df.schema[id].dataType.simpleString()
    source = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(encode, f"id {kind}, piece int, start long, length long, ids array<int>")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per item, longest first, each into the fullest bin it fits in."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with r left exists
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_rooms >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            b, left, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - left
        if left > n:
            room[left - n].append(b)
            open_rooms |= 1 << (left - n)
    return bins, offsets


def _round(items: DataFrame, turn: int, groups: int, capacity: int, enough: int) -> DataFrame:
    """(item, bin, offset, fill, done) for one round; a bin is named after its first item."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True])
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        first = np.zeros(len(fill), np.int64)
        first[bins[::-1]] = pdf["item"].to_numpy()[::-1]
        return pd.DataFrame(
            {"item": pdf["item"], "bin": first[bins], "offset": offsets, "fill": fill[bins], "done": fill[bins] >= enough}
        )

    dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, "item long, bin long, offset long, fill long, done boolean")


def pack(
    items: DataFrame, capacity: int = CAPACITY, nearly_full: float = 0.99, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """(item, sequence_id, offset) for items (item long, length long), 1 <= length <= capacity.

    Items must be distinct.  Sequences are gapless from offset 0.  Items as long as
    a sequence are not moved at all.
    """
    whole = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", "length")
    n, turn, rounds = rest.count(), 0, []
    while n:
        groups = -(-n // group_items)
        packed = stored(_round(rest, turn, groups, capacity, int(np.ceil(nearly_full * capacity))), "packing")
        rounds.append(packed)
        rest = packed.where("not done and item = bin").select("item", F.col("fill").alias("length"))
        carried, made = rest.count(), packed.where("item = bin").count()
        if groups == 1 or made > n - groups:
            break
        n, turn = carried, turn + 1
    final = None
    for packed in reversed(rounds):
        here = packed.select("item", "bin", "offset")
        if final is None:
            final = here.select("item", F.col("bin").alias("sequence_id"), "offset")
            continue
        above = final.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
        final = here.join(above, "bin", "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
        )
    return whole if final is None else whole.unionByName(final)


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of an array of ids as little-endian 32-bit words."""

    @F.pandas_udf("long")
    def of(arrays: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(x.astype("<u4", copy=False)) for x in arrays], dtype="int64")

    return of(ids)


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, **kw) -> DataFrame:
    """Pieces of all documents with their ids, ids_crc32, sequence_id and offset.

    Rows repeated, and rows that share an id or have none, are packed each for itself;
    ids of documents are carried, never computed with.  Texts of any length are packed
    whole; of equal lengths the earlier piece goes first.  An empty table gives no
    rows; other columns are not looked at.
    """
    pieces = stored(numbered(token_pieces(df, tokenizer, text, id, capacity)), "pieces")
    placed = pack(pieces.select("item", "length"), capacity, **kw)
    summed = pieces.withColumn("ids_crc32", ids_crc32(F.col("ids")))
    return summed.join(placed, "item").drop("item").withColumnRenamed("id", id)


def numbered(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("item", F.monotonically_increasing_id())
