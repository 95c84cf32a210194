"""WARC archives of pages and a merged capture index (operator 7).

Pages with equal payloads are stored once: the one with the largest page_id as response, the others as revisits of it.
Archives are text files of WARC/1.1 records, gzip-compressed, written by Spark's own sink. They are read back whole file
by file; each file's captures form a locally sorted run, and the runs of a key range are merged by a loser tree into
capture histories ordered by URL key, time and page.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.llm.common import parts, settle, shared_folder

#: Records in a file at most, and bytes that its uncompressed records should stay below: what one task reads at once.
FILE_RECORDS, FILE_BYTES = 10_000, 256_000_000
#: Captures that one range of the merge holds, about.
RANGE_ROWS = 100_000
BREAK = "\r\n"
PREFIX = "urn:page:"
CAPTURE_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, "
    "archive string, record_offset long"
)
NAMES = [c.split()[0] for c in CAPTURE_SCHEMA.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by built-in functions: five hex digits make four letters."""
    digits = F.sha1(payload.cast("binary"))
    letters = []
    for first in range(1, 41, 5):
        number = F.conv(F.substring(digits, first, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def label_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html, captured) with payload, record_type and refers_to.

    Equal payloads of at least `least_bytes` are found by SHA-256. Only groups of several pages are joined back, on both
    sides straight from an exchange, so that Spark splits a group with a third of all pages. Pages that carry the largest
    id of their group are responses, also if repeated; a null id counts as smallest.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit(""))).drop("html")
    rows = rows.withColumn("content", F.when(F.octet_length("payload") >= least_bytes, F.sha2(F.col("payload").cast("binary"), 256)))
    groups = rows.filter("content IS NOT NULL").groupBy("content").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copied = settle(groups, "copied")
    joined = rows.join(copied, "content", "left").drop("content")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("newest"))).drop("newest")


def record(row_id: Column, url: Column, captured: Column, payload: Column, kind: Column, refers_to: Column) -> Column:
    """The text of a WARC record without its two closing line breaks. A revisit keeps the HTTP headers only."""
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), size, F.lit(BREAK * 2))
    block = F.when(kind == "revisit", http).otherwise(F.concat(http, payload))
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit(f"WARC-Record-ID: <{PREFIX}"), F.coalesce(row_id.cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), captured), F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(payload)),
        F.concat(F.lit(f"WARC-Refers-To: <{PREFIX}"), refers_to.cast("string"), F.lit(">")),
        F.when(kind == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), block)


def record_bytes(payload: Column, url: Column) -> Column:
    """At least the length of a page's record."""
    return F.octet_length(payload) + F.octet_length(F.coalesce(url, F.lit(""))) * 3 + 1000


def write_warc(labelled: DataFrame, path: str, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES, longest: int | None = None) -> None:
    """One record for each row of label_copies, in gzip-compressed files below path.

    Files are bounded in bytes as well: records of a size class (powers of 16) have files of their own, with so many records
    as fit in file_bytes; a record longer than that is a file by itself. `longest` saves a pass where it is known.
    """
    size = record_bytes(F.col("payload"), F.col("url"))
    if longest is None:
        longest = labelled.agg(F.max(size)).first()[0] or 0
    low, high = -1, max(1, file_bytes // file_records)
    while low < longest:
        _write_class(labelled.filter((size > low) & (size <= high)), f"{path}/upto={high}", max(1, file_bytes // high))
        low, high = high, high * 16


def _write_class(labelled: DataFrame, path: str, file_records: int) -> None:
    text = labelled.select(record(*(F.col(c) for c in ("page_id", "url", "captured", "payload", "record_type", "refers_to"))).alias("value"))
    text.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query in lower case: pages of one site sort together."""
    if not url:
        return ""
    try:
        at = urlsplit(url)
        host, port = at.hostname or "", at.port
    except ValueError:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{host}){(at.path or '/').lower()}" + (f"?{at.query.lower()}" if at.query else "")


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        yield at, head, content[end + 4 : stop]
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        at = stop + 4


def _number(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(PREFIX)
    return None if value == "none" else int(value)


def _order(row: tuple) -> tuple:
    """URL key, time, page; a capture without time and a page without id come first."""
    return row[5], row[6] is not None, row[6] or "", row[0] is not None, row[0] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below path, each archive's in the order of the index. Payloads are hashed anew and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, head, block in records(zlib.decompress(content.as_buffer(), 31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the payload at byte {at} differs from its digest")
                    refers = _number(head["WARC-Refers-To"]) if revisit else None
                    rows.append((_number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, url_key(head.get("WARC-Target-URI")), head.get("WARC-Date"), name.rsplit("/", 1)[-1], at))
                rows.sort(key=_order)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE_SCHEMA)


def loser_tree_merge(runs: list[list[tuple]], key) -> Iterator[tuple]:
    """Merge sorted runs. Inner nodes hold the losers of their matches, so each row out costs one match for each level."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    head = [(0, key(r[0])) if r else (1,) for r in runs]  # (1,) stands for an exhausted run and loses against all
    tree = [-1] * k  # tree[0]: the winner
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node and tree[node] >= 0:
            if (head[tree[node]], tree[node]) < (head[winner], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[node] = winner
    while head[winner := tree[0]] != (1,):
        yield runs[winner][at[winner]]
        at[winner] += 1
        head[winner] = (0, key(runs[winner][at[winner]])) if at[winner] < len(runs[winner]) else (1,)
        node = (winner + k) // 2
        while node:
            if (head[tree[node]], tree[node]) < (head[winner], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def merge_index(captures: DataFrame) -> DataFrame:
    """Captures in global order: merge_range, and merge_position within it.

    Ranges are cut by URL key, time and page together, so a URL with a third of all captures spreads over ranges, and there
    are so many that a range holds about RANGE_ROWS captures, however many there are. Within a range each archive's rows are a run.
    Spark's sort, which spills, brings them run by run and each run in order; the loser tree then merges the runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        runs = [list(g) for _, g in groupby(rows, key=lambda r: r[7])]
        merged, piece, position = loser_tree_merge(runs, _order), TaskContext.get().partitionId(), 0
        while chunk := [r for _, r in zip(range(5000), merged, strict=False)]:
            columns = list(zip(*chunk, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            arrays += [pa.array(np.full(len(chunk), piece, np.int32)), pa.array(np.arange(position, position + len(chunk)))]
            position += len(chunk)
            yield pa.RecordBatch.from_arrays(arrays, [*NAMES, "merge_range", "merge_position"])

    order = ("url_key", "captured", "page_id", "archive", "record_offset")
    ranges = max(parts(captures), -(-captures.count() // RANGE_ROWS))
    ranged = captures.repartitionByRange(ranges, *order).sortWithinPartitions("archive", *order)
    return ranged.mapInArrow(run, CAPTURE_SCHEMA + ", merge_range int, merge_position long")


def capture_time(page_id: Column) -> Column:
    """A time for pages that have none: seconds of the page's number after 2020."""
    return F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def archive(pages: DataFrame, least_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """Write the archives of page_id, url and html, read them back and merge their index. Null html counts as empty; a capture
    without time has no date in its record and comes first among those of its URL."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", (capture_time(F.col("page_id")) if captured is None else captured).alias("captured"))
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    longest = rows.agg(F.max(record_bytes(F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url")))).first()[0] or 0
    write_warc(label_copies(rows, least_bytes), path, longest=longest)
    return merge_index(settle(read_runs(pages.sparkSession, path), "captures"))
