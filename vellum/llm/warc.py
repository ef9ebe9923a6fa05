"""WARC archives of pages, and an index of captures merged from sorted runs.

Writing: each page is one record. Of pages with equal payloads of at least `least` bytes, the one with the
smallest id is a `response`, the others are `revisit` records that name it and have no payload; smaller payloads are all
responses. Spark writes the records as text files with CRLF CRLF between them, gzipped, so archives go to any file
system that Spark can write. A file is one gzip member; places are offsets in the archive as inflated. Files hold
`records_per_file` records at most, and fewer where pages are large: about `file_bytes` by their mean size.

Reading: each archive is inflated piece by piece and parsed by its Content-Length fields, so a task holds the compressed archive,
one record and the archive's entries; the payload's length and SHA-256 are computed from the bytes read, for a revisit they come
from its header. The captures of an archive, sorted by URL key, time, id and place, are a run, numbered in that order.
Spark cuts all runs at common key ranges and lays each range out run by run in the runs' own order; a loser tree merges the
runs of a range, and the ranges in order are the global history. The range key ends with the place in the archive, so a
hot host, URL or repeated row spreads over ranges; the driver holds one row count a range.

Payload groups are pre-aggregated by digest; a page meets its group in a join that adaptive execution may split.

Cases: null html is an empty payload; a null url is an empty one, line breaks in it are percent-encoded; null page ids are
kept, never named by a revisit, and revisit a page with an id where there is one; rows with the same id and payload are
all responses if that id is the smallest; repeated rows each come back, ordered by archive and place; very long pages are
records like others; an empty table gives empty archives and index. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly key: host labels from the top domain down, then path and sorted query; no scheme, port or fragment."""
    try:
        u = urlsplit(url if "//" in url else "//" + url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return (",".join(reversed(host.split("."))) + ")" + (u.path or "/") + ("?" + query if query else "")).lower()


def with_types(pages: DataFrame, least: int = 100, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Columns id, url, payload, bytes, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    groups = base.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    groups = written(groups, "payloads")
    return base.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def records(typed: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """(value): the text of one record a row, without the CRLF CRLF that ends it."""
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.coalesce(F.pmod("id", F.lit(31_536_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))), F.concat(F.lit("WARC-Date: "), at), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string"))]
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to"))))
    tail = [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return typed.select(F.concat(F.concat_ws("\r\n", *lines, more, *tail), F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 100, records_per_file: int = 2000, file_bytes: int = 64 << 20) -> None:
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    records_per_file = max(1, min(records_per_file, int(file_bytes / (mean + 1000))))
    records(with_types(pages, least)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Inflated:
    """The bytes of a gzip file, inflated as they are read."""

    def __init__(self, data: memoryview, step: int = 1 << 16):
        self.data, self.step, self.next, self.at = data, step, 0, 0
        self.inflate, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.inflate.eof and (rest := self.inflate.unused_data or bytes(self.data[self.next : self.next + self.step])):
            self.next += 0 if self.inflate.unused_data else len(rest)
            self.inflate = zlib.decompressobj(31)
        elif rest := self.inflate.unconsumed_tail or bytes(self.data[self.next : self.next + self.step]):
            self.next += 0 if self.inflate.unconsumed_tail else len(rest)
        else:
            return False
        self.held += self.inflate.decompress(rest, 16 * self.step)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed too; None at the end."""
        seen = 0
        while (end := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError(f"cut off at byte {self.at}")
                return None
        return self.take(end + len(mark))[:end]

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError(f"cut off at byte {self.at}")
        out = bytes(self.held[:size])
        del self.held[:size]
        self.at += size
        return out


def parse(data: memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a gzipped archive."""
    source = _Inflated(data)
    while (at := source.at, head := source.until(b"\r\n\r\n"))[1] is not None:
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        yield at, fields, source.take(int(fields["Content-Length"]))
        source.take(4)


ENTRY = "urlkey string, ts string, page_id long, archive string, place long, seq long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(name: str) -> int | None:
    x = name.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


def _order(row) -> tuple:
    """The order of captures; null ids first."""
    return row["urlkey"], row["ts"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["place"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A run of index entries for each archive, sorted; written in the shared folder."""
    whole = spark.read.format("binaryFile").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("archive"))

    def run(batches):
        for batch in batches:
            for content, archive in zip(batch.column("content"), batch.column("archive"), strict=True):
                rows = []
                for at, h, block in parse(memoryview(content.as_buffer())):
                    entry = {"urlkey": url_key(h["WARC-Target-URI"]), "ts": h["WARC-Date"], "page_id": _id(h["WARC-Record-ID"]), "archive": archive.as_py(), "place": at, "record_type": h["WARC-Type"], "refers_to": None}
                    if h["WARC-Type"] == "revisit":
                        entry |= {"payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": _id(h["WARC-Refers-To"])}
                    else:
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        entry |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                    rows.append(entry)
                if rows:
                    run_ = [row | {"seq": i} for i, row in enumerate(sorted(rows, key=_order))]
                    yield pa.RecordBatch.from_pylist(run_, SCHEMA)

    return written(whole.mapInArrow(run, ENTRY), "runs")


SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in ENTRY.split(", ")])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs log2(k) matches."""

    def __init__(self, runs: list[list], key):
        self.key, self.iters = key, [iter(r) for r in runs]
        self.k = len(runs)
        self.head: list = [None] * self.k
        self.node = [0] * max(1, self.k)
        for i in range(self.k):
            self._pull(i)
        if self.k:
            self.node[0] = self._build(1)

    def _pull(self, i: int) -> None:
        row = next(self.iters[i], None)
        self.head[i] = None if row is None else (self.key(row), row)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.node[node] = (a, b) if self._wins(a, b) else (b, a)
        return win

    def __iter__(self):
        while self.k and (top := self.head[win := self.node[0]]) is not None:
            yield top[1]
            self._pull(win)
            at = (win + self.k) // 2
            while at:
                if self._wins(self.node[at], win):
                    win, self.node[at] = self.node[at], win
                at //= 2
            self.node[0] = win


def merge_index(runs: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """The entries of all runs with index_pos, their place from 0 in the global order."""
    spark, names = runs.sparkSession, [c for c in runs.columns if c != "seq"]
    ranges = max(1, -(-runs.count() // range_rows))
    keys = ["urlkey", "ts", F.col("page_id").asc_nulls_first(), "archive", "place"]
    laid = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("archive", "seq").withColumn("range", F.spark_partition_id())

    def merge(batches):
        rows, own = [], 0
        for batch in batches:
            rows.extend(batch.to_pylist())
        merged = iter(LoserTree([list(run) for _, run in groupby(rows, lambda r: r["archive"])], _order))
        while some := [row for row in islice(merged, 10_000)]:
            yield pa.RecordBatch.from_pylist([row | {"own": own + i} for i, row in enumerate(some)], MERGED)
            own += len(some)

    merged = written(laid.mapInArrow(merge, f"{ENTRY}, range int, own long"), "merged")
    count = {r["range"]: r["count"] for r in merged.groupBy("range").count().collect()}
    base = spark.sparkContext.broadcast(_running(count))

    def number(batches):
        for batch in batches:
            at = pa.array([base.value[x] + y for x, y in zip(batch.column("range").to_pylist(), batch.column("own").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), at], names=[*names, "index_pos"])

    kinds = ", ".join(x for x in ENTRY.split(", ") if x != "seq long")
    return merged.mapInArrow(number, f"{kinds}, index_pos long")


MERGED = SCHEMA.append(pa.field("range", pa.int32())).append(pa.field("own", pa.int64()))


def _running(count: dict[int, int]) -> dict[int, int]:
    out, at = {}, 0
    for k in sorted(count):
        out[k], at = at, at + count[k]
    return out


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    index = merge_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "index_pos")
