"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a segment is a word with its blank marks) are laid
end to end and all their suffixes sorted.  Every piece of the vocabulary is then a
binary search for the range of suffixes that start with it, which yields all places
where a piece may stand: edges (start, end, piece).  Sorted by position, they are
relaxed segment by segment: the best-ranked edge that spans exactly two current
symbols joins them, until none is left.  Characters no piece covers become bytes.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_SEGMENTS = 1 << 18
BATCH = 1024


# No piece holds a mark after another character, so no piece crosses these segments.
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encoder and decoder of one merge-based piece model with byte fallback."""

    def __init__(self, path: str, cached: int = CACHED_SEGMENTS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int32)
        own = [p.encode() for p in self.pieces]
        self.rank: dict[str, int] = {}
        scores = sorted({-model.get_score(i) for i in range(n)})
        place = {score: k for k, score in enumerate(scores)}
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                b = int(p[3:5], 16)
                self.bytes[b], own[i] = i, bytes([b])
            elif model.is_control(i) or model.is_unknown(i):
                own[i] = b""
            else:
                self.rank[p], self.id[p] = place[-model.get_score(i)], i
        self.size = np.array([len(x) for x in own])
        self.begin = np.cumsum(self.size) - self.size
        self.utf8 = np.frombuffer(b"".join(own), np.uint8)
        self.longest = max(map(len, self.rank))
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.joined = sorted(p for p in self.rank if len(p) > 1)
        self.joined_low = np.array(self.joined, f"<U{self.longest + 1}")
        self.joined_high = np.array([p + "\U0010ffff" for p in self.joined], f"<U{self.longest + 1}")
        self.joined_rank = np.array([self.rank[p] for p in self.joined])
        self.joined_id = np.array([self.id[p] for p in self.joined], np.int32)
        self.joined_size = np.array([len(p) for p in self.joined])
        self.cached = cached
        self.forget()

    def forget(self) -> None:
        """Start the memory of segments over: their numbers, and their ids end to end."""
        self.known: dict[str, int] = {}
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, rank, id) of every occurrence of a piece of two characters or more, by place.

        A place is start * (longest + 1) + length.
        """
        width = self.longest
        padded = np.concatenate([code, np.zeros(width, "<u4")])
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(code)]
        suffixes = np.ascontiguousarray(windows).view(f"<U{width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        arranged = suffixes[order]
        low = np.searchsorted(arranged, self.joined_low, "left")
        count = np.searchsorted(arranged, self.joined_high, "right") - low
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        places = order[low[which] + inside] * (width + 1) + self.joined_size[which]
        by_place = np.argsort(places)
        which = which[by_place]
        return places[by_place], self.joined_rank[which], self.joined_id[which]

    def learn(self, segments: list[str]) -> None:
        """Ids of new segments, all relaxed at once: in each round every segment joins
        the two neighbouring symbols under its best-ranked edge, the leftmost of equals.
        Only the pairs beside a join are looked up again."""
        code = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le"), "<u4")
        places, ranks, ids = self.edges(code)
        none = len(self.pieces) + 1
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        start = np.arange(len(owner)) + owner
        end, symbol = start + 1, self.single[code[start]]

        def look(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = end[left + 1] - start[left]
            fits = (owner[left + 1] == owner[left]) & (size <= self.longest)
            key = start[left] * (self.longest + 1) + np.where(fits, size, 0)
            if not len(places):
                return np.full(len(left), none), np.full(len(left), -1, np.int32)
            at = np.minimum(np.searchsorted(places, key), len(places) - 1)
            found = places[at] == key
            return np.where(found, ranks[at], none), ids[at]

        best, joins = np.full(len(start), none), np.full(len(start), -1, np.int32)
        best[:-1], joins[:-1] = look(np.arange(len(start) - 1))
        settled: list[tuple[np.ndarray, ...]] = []
        while len(start):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(start)))
            least = np.minimum.reduceat(best, first)
            over = np.repeat(least == none, count)
            settled.append((owner[over], start[over], symbol[over]))
            hit = np.flatnonzero((best == np.repeat(least, count)) & ~over)
            chosen = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit
            end[chosen], symbol[chosen] = end[chosen + 1], joins[chosen]
            keep, beside = ~over, np.zeros(len(start), bool)
            keep[chosen + 1] = False
            beside[chosen] = beside[np.maximum(chosen - 1, 0)] = True
            owner, start, end, symbol, best, joins, beside = (x[keep] for x in (owner, start, end, symbol, best, joins, beside))
            if len(start):
                best[-1] = none
                left = np.flatnonzero(beside[:-1])
                best[left], joins[left] = look(left)
        owner, start, symbol = (np.concatenate(x) for x in zip(*settled))
        order = np.argsort(start)
        owner, start, symbol = owner[order], start[order], symbol[order]
        # A character without a piece becomes its bytes.
        bare, char = symbol < 0, code[start]
        n = np.where(bare, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
        out = np.repeat(symbol, n)
        raw = char[bare].astype("<u4").tobytes().decode("utf-32-le").encode()
        out[np.repeat(bare, n)] = self.bytes[np.frombuffer(raw, np.uint8)]
        sizes = np.bincount(owner, n, len(segments)).astype(np.int64)
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.count = np.append(self.count, sizes)
        self.ids = np.append(self.ids, out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        fresh = list(dict.fromkeys(s for s in flat if s not in self.known))
        if fresh and len(self.known) + len(fresh) > self.cached:
            self.forget()
            fresh = list(dict.fromkeys(flat))
        for i in range(0, len(fresh), 50_000):
            self.learn(fresh[i : i + 50_000])
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n = self.count[which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[which] - ends + n, n) + np.arange(int(n.sum()))]
        bounds = np.append(0, ends)[np.cumsum([0] + [len(p) for p in parts])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.begin[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
        text = self.utf8[at].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(df: DataFrame, model: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) per row; null and empty texts have no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = codec(model)
        for texts in batches:
            out = []
            for i in range(0, len(texts), BATCH):
                out.extend(encoder.encode(texts.iloc[i : i + BATCH].tolist()))
            yield pd.Series(out, dtype=object)

    return df.select(F.col(f"`{id}`").alias(id), ids(F.col(f"`{text}`").cast("string")).alias("ids"))


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; null ids give null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = codec(model)
        for rows in batches:
            yield pd.Series([None if x is None else decoder.decode(np.asarray(x)) for x in rows], dtype=object)

    return df.withColumn(to, text(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, model: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: id, n_ids, ids_crc32 and whether decoding gives the text back.

    Null counts as empty (no ids, text given back).  A text decodes to itself unless
    it holds the mark character, which stands for a blank.  Repeated rows are coded
    each for itself; an empty table gives no rows; other columns are not looked at.
    """

    @F.pandas_udf("n_ids long, ids_crc32 long, same boolean")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = codec(model)
        for texts in batches:
            rows = []
            for i in range(0, len(texts), BATCH):
                part = texts.iloc[i : i + BATCH].tolist()
                for t, ids in zip(part, both.encode(part)):
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), both.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "same"])

    c = coded(F.col(f"`{text}`").cast("string")).alias("c")
    return df.select(F.col(f"`{id}`").alias(id), c).select(id, "c.n_ids", "c.ids_crc32", F.col("c.same").alias("round_trip"))
