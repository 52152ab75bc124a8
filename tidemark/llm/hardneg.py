"""Hard negatives by Kronecker-packed integer products.

Rows and anchors are dealt into blocks of a fixed number of rows, and every block of
anchors meets every block of rows once, as one tile: the anchors are a stated query
set.  Tasks read the stored blocks side by side; no copy of a block is shuffled or
broadcast.  In a tile the components of several rows, biased so that none is negative, lie
side by side in the fields of one wide integer.  A field is wide enough for the whole
inner product of biased components, so one multiplication per anchor component adds to
all fields at once and no field reaches its neighbour; taking the biases off again
gives exact scores.  A tile keeps at most ``positives`` or ``negatives`` rows per
anchor or positive, and those few are ranked over all tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

LANE_BITS = 63  # of a signed machine word; wider fields take Python's own integers
WIDE_FIELDS = 16
ANCHOR_STEP = 32
BLOCK = "block long, tag array<long>, id array<long>, label array<long>, q array<long>"


def quantised(df: DataFrame, vector: str, id: str, label: Column, scale: int) -> DataFrame:
    """(tag, id, label, q) of the rows that take part; tags tell repeated rows apart."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(finite & label.isNotNull()).select(
        F.col(f"`{id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c)).alias("q")
    )
    return stored(rows.withColumn("tag", F.monotonically_increasing_id()), "quantised")


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, longest vector, largest component."""
    most = F.max(F.array_max(F.transform("q", lambda c: F.abs(c))))
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), most).first()
    return n, dim or 0, top or 0


def blocks(rows: DataFrame, n: int, size: int, dim: int) -> DataFrame:
    """One row per block of about ``size`` rows, in order of id; vectors filled up with zeros."""
    count = max(1, -(-n // size))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=schema).sort_by([("id", "ascending"), ("tag", "ascending")])
        if len(t):
            q = t["q"].combine_chunks()
            size_of = np.diff(q.offsets.to_numpy())
            whole = np.zeros((len(t), dim), np.int64)
            whole[np.arange(dim) < size_of[:, None]] = q.flatten().to_numpy()
            one = lambda a, kind=pa.int64(): pa.array([a], pa.list_(kind))
            columns = [pa.array([TaskContext.get().partitionId()]), *(one(t[c].combine_chunks()) for c in ("tag", "id", "label")), one(whole.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "tag", "id", "label", "q"])

    schema = pa.schema([("tag", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int64()))])
    dealt = rows.select("tag", "id", "label", "q").repartition(count)
    return stored(dealt.mapInArrow(gather, BLOCK), "blocks")


def packed(q: np.ndarray, bias: int, width: int) -> np.ndarray:
    """(dim, lanes): row f * lanes + i of ``q`` lies in field f of lane i."""
    fields = LANE_BITS // width
    kind = np.int64 if fields > 1 else object
    fields = fields if fields > 1 else WIDE_FIELDS
    lanes = -(-len(q) // fields)
    biased = np.zeros((fields * lanes, q.shape[1]), kind)
    biased[: len(q)] = q.astype(kind) + bias
    out = np.zeros((q.shape[1], lanes), kind)
    for f in range(fields):
        out += biased[f * lanes : (f + 1) * lanes].T * kind(1 << width * f) if kind is np.int64 else biased[f * lanes : (f + 1) * lanes].T << width * f
    return out


def products(anchors: np.ndarray, q: np.ndarray, a_bias: int, bias: int, width: int) -> np.ndarray:
    """Exact inner products (anchors, rows): one multiplication per anchor component and lane."""
    wide = packed(q, bias, width)
    kind = wide.dtype
    own = anchors.astype(kind) + a_bias
    total = np.zeros((len(own), wide.shape[1]), kind)
    for i in range(0, len(own), ANCHOR_STEP):
        for j in range(wide.shape[0]):
            total[i : i + ANCHOR_STEP] += own[i : i + ANCHOR_STEP, j, None] * wide[j]
    fields = LANE_BITS // width if kind == np.int64 else WIDE_FIELDS
    mask = (1 << width) - 1
    found = np.concatenate([total >> (width * f) & mask for f in range(fields)], axis=1)[:, : len(q)]
    found = found - bias * anchors.astype(kind).sum(1)[:, None] - a_bias * (q.astype(kind) + bias).sum(1)[None]
    return found.astype(np.int64)


def field_width(dim: int, a_bias: int, bias: int) -> int:
    """Bits that hold any sum of products of biased components."""
    if dim * a_bias * bias >= 1 << 62:
        raise ValueError("scores of these vectors do not fit a long")
    return max(1, (dim * 4 * a_bias * bias).bit_length())


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to ``k`` times: (lines, places) of the highest allowed score of each line, the first of equals."""
    low = np.iinfo(np.int64).min
    left = np.where(allowed, scores, low)
    for _ in range(k):
        at = left.argmax(1)
        lines = np.flatnonzero(left[np.arange(len(left)), at] > low) if left.shape[1] else np.zeros(0, np.int64)
        if not len(lines):
            return
        yield lines, at[lines]
        left[lines, at[lines]] = low


def tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors (columns a_*) beside every block of rows, both stored tables.

    Parts of both tables meet as they lie.  An exchange would carry a copy of each block per
    block it meets, and by their files' size, which knows nothing of copies, Spark might even
    broadcast them.  A task keeps its part of the anchors and streams the rows.
    """
    return rows.hint("shuffle_replicate_nl").crossJoin(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]))


def _tile(batch: pa.RecordBatch, i: int, dim: int) -> dict:
    """Row i as arrays; nulls of ids stay in the Arrow array."""
    out = {}
    for name in batch.schema.names:
        if name in ("block", "a_block"):
            continue
        cell = batch.column(name)[i].values
        out[name] = cell if name in ("id", "a_id") else cell.to_numpy(zero_copy_only=False)
        if name in ("q", "a_q"):
            out[name] = out[name].reshape(-1, dim)
    return out


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    vector: str = "embedding",
    id: str = "vec_id",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    anchor_block: int = 512,
    row_block: int = 4096,
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x), a score is the integer inner product with
    the anchor; higher scores come first, ties by smaller id, null ids last, then by
    row.  ``anchor`` says of the column ``id`` whether a row is an anchor (null: no).
    An anchor's positives are its first other rows of the same label, a positive's
    negatives the first rows of other labels with ``least`` to ``most`` hundredths of
    its score.  Rows with a null label, a null vector or a null or non-finite
    component take no part; shorter vectors are filled up with zeros, empty ones score
    zero.  Rows repeated count each for itself, also as anchors; an empty table gives
    no rows; other columns are not looked at.  Scores that a long cannot hold raise.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = quantised(df, vector, id, label, scale)
    asked = rows.where(anchor)
    (n, dim, top), (n_asked, _, a_top) = extent(rows), extent(asked)
    width, dim = field_width(dim, a_top, top), max(1, dim)
    lines, every = blocks(asked, n_asked, anchor_block, dim), blocks(rows, n, row_block, dim)

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = _tile(batch, i, dim)
                for value in np.intersect1d(t["a_label"], t["label"]):
                    a, b = np.flatnonzero(t["a_label"] == value), np.flatnonzero(t["label"] == value)
                    scores = products(t["a_q"][a], t["q"][b], a_top, top, width)
                    for at, place in best(scores, t["a_tag"][a][:, None] != t["tag"][b][None], positives):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t["a_tag"][a[at]]), pa.array(t["tag"][b[place]]), t["id"].take(pa.array(b[place])), pa.array(scores[at, place])],
                            ["a_tag", "p_tag", "p_id", "p_score"],
                        )

    first = lambda by, score, id, tag: Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id), tag)
    near = tiles(lines, every).mapInArrow(same_label, "a_tag long, p_tag long, p_id long, p_score long")
    place = F.row_number().over(first(["a_tag"], "p_score", "p_id", "p_tag"))
    found = stored(near.withColumn("slot", place).where(F.col("slot") <= positives), "positives")
    # Everything an anchor asks for, in its block's row: lists as long as the block, bounded like it.
    slots = found.groupBy("a_tag").agg(F.sort_array(F.collect_list(F.struct("slot", "p_score"))).alias("s"))
    of_block = lines.select(F.col("block"), F.posexplode("tag").alias("pos", "a_tag")).join(slots.hint("merge"), "a_tag")
    wanted = of_block.groupBy("block").agg(
        *[F.collect_list(c).alias(n) for c, n in ((F.col("pos").cast("long"), "pos"), (F.transform("s", lambda x: x["p_score"]), "scores"))]
    )
    asking = stored(lines.join(wanted.hint("merge"), "block"), "asking")

    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                wanted_at, wanted_scores = batch.column("a_pos")[i].values.to_numpy(), batch.column("a_scores")[i].as_py()
                t = _tile(batch.select([c for c in batch.schema.names if c not in ("a_pos", "a_scores")]), i, dim)
                scores = products(t["a_q"][wanted_at], t["q"], a_top, top, width)
                other = t["a_label"][wanted_at][:, None] != t["label"][None]
                for slot in range(positives):
                    at = [k for k, s in enumerate(wanted_scores) if len(s) > slot]
                    if not at:
                        break
                    asked_score = [wanted_scores[k][slot] for k in at]
                    low = np.array([-(-least * s // 100) for s in asked_score])[:, None]
                    high = np.array([most * s // 100 for s in asked_score])[:, None]
                    part = scores[at]
                    for k, place in best(part, other[at] & (part >= low) & (part <= high), negatives):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(t["a_tag"][wanted_at[np.array(at)[k]]]), pa.array(np.full(len(k), slot + 1, np.int32)),
                                pa.array(t["tag"][place]), t["id"].take(pa.array(place)), pa.array(part[k, place]),
                            ],
                            ["a_tag", "slot", "n_tag", "negative_id", "negative_score"],
                        )

    far = tiles(asking, every).mapInArrow(other_label, "a_tag long, slot int, n_tag long, negative_id long, negative_score long")
    rank = F.row_number().over(first(["a_tag", "slot"], "negative_score", "negative_id", "n_tag"))
    ranked = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = found.hint("merge").join(rows.select(F.col("tag").alias("a_tag"), F.col("id").alias("anchor_id")), "a_tag")
    return named.join(ranked, ["a_tag", "slot"]).select(
        "anchor_id", F.col("p_id").alias("positive_id"), "rank", "negative_id", F.col("p_score").alias("positive_score"), "negative_score"
    )
