"""WARC archives: writing, reading back, and a merged index of captures.

Records are text lines whose separator is the empty line that ends a WARC record,
so Spark's own text sink writes valid archives into any store it can reach.  They
are read back as binary files and cut by Content-Length, never by separator.  Each
archive yields a run of captures sorted by url key and time; runs are
range-partitioned by that key and merged by a loser tree, which gives every url's
capture history in global order.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, whole
from tidemark.sources.storage import fresh_path, stored

EPOCH = 1704067200  # 2024-01-01, the time of capture 0 where the table has none
LEAST_BYTES = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = (
    "urlkey string, captured string, id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, at long"
)
TEXT_INDEX = INDEX.replace(", id long", ", id string").replace("refers_to long", "refers_to string")


def capture_records(df: DataFrame, url: str = "url", html: str = "html", id: str = "page_id") -> DataFrame:
    """One column of WARC records.

    Of equal payloads of at least 100 bytes the one with the smallest id is a
    response, the others revisit it without their payload.
    """
    payload = whole(F.col(f"`{html}`"))
    pages = df.select(
        F.col(f"`{id}`").cast("long").alias("id"), whole(F.col(f"`{url}`")).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    firsts = pages.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    pages = pages.join(firsts.where("n > 1").select("digest", "first"), "digest", "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.col("id").isNull() & F.col("first").isNotNull())
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    clean = F.regexp_replace("url", r"[\r\n]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    capture = lambda n: F.concat(F.lit("<urn:capture:"), F.coalesce(n.cast("string"), F.lit("none")), F.lit(">"))
    at = F.date_format(F.timestamp_seconds(F.lit(EPOCH)), "yyyy-MM-dd'T'HH:mm:ss'Z'")  # pages have no time of their own
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", capture(F.col("first"))),
    )
    return pages.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", capture(F.col("id"))),
            line("WARC-Date", at),
            line("WARC-Target-URI", clean),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            line("WARC-Payload-Length", F.col("bytes").cast("string")),
            F.when(again, revisit).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(df: DataFrame, path: str, records_per_file: int = 20_000, **columns: str) -> str:
    """Write gzip-compressed archives below ``path``; files hold a bounded number of records."""
    writer = capture_records(df, **columns).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)
    return path


def url_key(url: str) -> str:
    """Sort-friendly form: reversed host, then path and query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url
    return f"{','.join(reversed(host))}){parts.path}{'?' + parts.query if parts.query else ''}".lower()


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, place) of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        yield headers, block[block.index(b"\r\n\r\n") + 4 :], at
        at = end + 4 + len(block) + 4


def _number(urn: str) -> str | None:
    """The id in a record's name, as text: pandas would make doubles of long ids beside nulls."""
    name = urn.rsplit(":", 1)[1].rstrip(">")
    return None if name == "none" else name


def _as_long(index: DataFrame) -> DataFrame:
    return index.withColumns({c: F.col(c).cast("long") for c in ("id", "refers_to")})


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives below ``path``; each file is one run, sorted by key and time.

    Digest and length of a response are computed from its payload; a revisit carries
    those of the payload it stands for.
    """

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for h, payload, at in parse_archive(gzip.decompress(content)):
                    revisit = h["WARC-Type"] == "revisit"
                    size = int(h["WARC-Payload-Length"]) if revisit else len(payload)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    rows.append(
                        (url_key(h["WARC-Target-URI"]), h["WARC-Date"], _number(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, digest,
                         h["WARC-Type"], _number(h["WARC-Refers-To"]) if revisit else None, name.rsplit("/", 1)[-1], at)
                    )
                rows.sort(key=_order)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return _as_long(files.mapInPandas(captures, TEXT_INDEX))


def _order(row) -> tuple:
    missing = row[2] is None
    return row[0], row[1], missing, 0 if missing else int(row[2]), row[8], row[9]


def loser_tree_merge(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """Merge sorted runs; every step replays one path from a leaf to the root."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    now = [next(h, None) for h in heads]
    keys = [None if x is None else key(x) for x in now]
    beats = lambda a, b: keys[b] is None or (keys[a] is not None and keys[a] <= keys[b])
    losers, winners = [0] * k, [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while keys[best] is not None:
        yield now[best]
        now[best] = next(heads[best], None)
        keys[best] = None if now[best] is None else key(now[best])
        node = (best + k) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


def merged_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of url key, time and id, merged from their runs.

    A hot url is split too: time and id belong to the range.  A task holds the
    index rows of one range, not payloads.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[tuple]] = {}
        columns = None
        for pdf in batches:
            columns = pdf.columns
            for row in pdf.itertuples(index=False, name=None):
                runs.setdefault(row[8], []).append(row)
        if columns is None:
            return
        block = []
        for row in loser_tree_merge([*runs.values()]):
            block.append(row)
            if len(block) == 10_000:
                yield pd.DataFrame(block, columns=columns)
                block = []
        if block:
            yield pd.DataFrame(block, columns=columns)

    n = partitions(captures.sparkSession)
    late = F.col("id").isNull()
    ranged = captures.repartitionByRange(n, "urlkey", "captured", late, "id", "file")
    runs = ranged.sortWithinPartitions("file", "urlkey", "captured", late, "id", "at")
    text = runs.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    return _as_long(text.mapInPandas(merge, TEXT_INDEX))


def archive_and_index(df: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Archive all captures, read the archives back, and return the merged index.

    Null urls and payloads count as empty; of rows that repeat the smallest id of a
    payload each is a response; rows with a null id revisit a payload that has an id; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = df.sparkSession
    where = write_archives(df, path or fresh_path(spark, "archives"), **columns)
    return merged_index(stored(read_captures(spark, where), "runs"))
