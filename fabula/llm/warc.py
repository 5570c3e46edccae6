"""WARC archives of pages, and their capture index by external merge.

Each page becomes a WARC 1.1 record: the first page (smallest page_id) of equal payloads is a response, the others are
revisits that refer to it and store only the HTTP header. Every record is a gzip member of its own, so a capture's place and
length in the index can be sought; tasks write members, sorted by URL key and capture time, into files bounded by bytes, and
a file counts once the table of files names it, so a lost or repeated task leaves nothing that is read. Archives are read as
streams, a member at a time, and checked against their digests. Each file is a sorted run of captures; runs are cut into
ranges of (URL key, time, page_id) of about ``RANGE_ROWS`` rows, however many rows there are, and a loser tree merges the runs
of a range, so the ranges, one after the other, are the globally ordered capture history of every URL.

Defined cases: a null html is an empty payload; a null url is ``urn:none``; rows that repeat a page_id are captures of
their own, and with one payload they are all responses if that id is the smallest; a null page_id sorts first and never
is the one referred to while another id has the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import fresh_path, materialize, shuffle_partitions, table

# Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

#: Compressed bytes of a file; a longer record has a file of its own.
FILE_BYTES = 128 << 20
#: Bytes that a reader asks for at a time.
READ_BYTES = 1 << 16
#: Captures in a range of the merged index.
RANGE_ROWS = 250_000
#: A payload of more than 1 / HEAVY of all pages is looked up in a broadcast table; there are fewer than HEAVY of them.
HEAVY = 2000
SALTS = 4096
FIRST_CAPTURE = 1_700_000_000


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal digest of 40 digits: five digits are four letters."""
    letters = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(hex_digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _surt(url: str) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url)
    if not m:
        return url.lower()
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2].lower() or "/")


def surt(url: Column) -> Column:
    """The same key as a column, to sort the files by."""
    host = F.lower(F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?[^/:?#]*(?::\d+)?([^#]*)", 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//"), key).otherwise(F.lower(url))


def with_first(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Adds ``first_id``, the smallest page_id of the payload. Pages of a very frequent payload (blank ones, say) get it from a
    broadcast table and are spread over all tasks; the others are joined by digest."""
    firsts = materialize(rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "warc-payloads")
    floor = (firsts.agg(F.sum("n")).first()[0] or 0) / heavy
    frequent = firsts.where(F.col("n") > floor).select("sha1", F.col("first_id").alias("frequent_first"), F.lit(True).alias("frequent"))
    spread = F.concat("sha1", F.lit("-"), F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)).cast("string"))
    rows = rows.join(F.broadcast(frequent), "sha1", "left").withColumn("spread", F.when(F.col("frequent"), spread).otherwise(F.col("sha1")))
    rows = rows.join(firsts.select(F.col("sha1").alias("spread"), "first_id"), "spread", "left")
    return rows.withColumn("first_id", F.when(F.col("frequent"), F.col("frequent_first")).otherwise(F.col("first_id")))


def warc_records(pages: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(surt, capture, page_id, value): each page's record without its end mark."""
    url = F.coalesce("url", F.lit("urn:none"))
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", url.alias("uri"), html.alias("payload"), F.sha1(html.cast("binary")).alias("sha1"))
    rows = with_first(rows, heavy)
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    capture = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000)))
    when = F.date_format(F.convert_timezone(None, F.lit("UTC"), capture.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), ident("page_id"), F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), ident("first_id"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string"), F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    return rows.select(surt(F.col("uri")).alias("surt"), when.alias("capture"), "page_id", head.alias("value"))


FILES = "path string, n_records long, n_bytes long"


def gzip_member(*parts) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*(packer.compress(x) for x in parts), packer.flush()])


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, heavy: int = HEAVY) -> None:
    """WARC files of one gzip member a record, each locally sorted by URL key and capture time, and the table of them."""

    def written(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, seq, out = TaskContext.get().partitionId(), 0, None

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [records], "n_bytes": [size]})

        for batch in batches:
            for value in batch.column("value"):
                member = gzip_member(value.as_buffer(), END.encode())
                if out is not None and size + len(member) > file_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, records, size = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, seq = fs.open_output_stream(f"{base}/{name}", compression=None), seq + 1
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            yield close()

    runs = warc_records(pages, heavy).sortWithinPartitions("surt", "capture", "page_id").select("value")
    runs.mapInArrow(written, FILES).write.parquet(f"{folder}/files")


def gzip_members(source):
    """(place, length, content) of the gzip members of a stream, one at a time."""
    at, held = 0, source.read(READ_BYTES)
    while held:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            held = held or source.read(READ_BYTES)
            if not held:
                raise ValueError(f"the archive ends within the record at byte {at}")
            parts.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield at, used, b"".join(parts)
        at, held = at + used, held or source.read(READ_BYTES)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block goes by Content-Length, whatever stands in it."""
    stop = data.find(b"\r\n\r\n")
    lines = data[: max(stop, 0)].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    end = stop + 4 + int(headers["content-length"])
    if data[end:] != END.encode():
        raise ValueError(f"the record {headers.get('warc-record-id')} has no end mark")
    return headers, data[stop + 4 : end]


def record_at(path: str, place: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record that an index row points at, without reading what stands before it."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as source:
        source.seek(place)
        return parse_record(zlib.decompress(source.read(length), 31))


CAPTURES = "run string, surt string, capture string, page_id long, place long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]


def _page(ident: str | None) -> int | None:
    return None if ident is None or ident == "<urn:page:none>" else int(ident[10:-1])


def _capture(path: str, at: int, length: int, data: bytes) -> tuple:
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].partition(":")[2]
    if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
    return path, _surt(headers["warc-target-uri"]), headers["warc-date"], _page(headers["warc-record-id"]), at, length, size, digest, headers["warc-type"], _page(headers.get("warc-refers-to"))


def _captures(batches):
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = pafs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_stream(name, compression=None) as source:
                for at, length, data in gzip_members(source):
                    rows.append(_capture(path, at, length, data))
                    if len(rows) == 5000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives of a folder, checked against their digests."""
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    # a number given outright, or adaptive execution would put these few small rows, and so all files, into one task
    spread = files.select("path").repartition(max(1, min(files.count(), 8 * shuffle_partitions(spark))))
    return spread.mapInArrow(_captures, CAPTURES)


class LoserTree:
    """Merges sorted runs of keys: inner nodes keep the loser of their match, so each step replays one path."""

    DONE = (1,)  # larger than every (0, key)

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(runs))]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for leaf in range(len(runs)):
            self._play(leaf, building=True)

    def _next(self, run: int):
        return next(((0, key, run) for key in self.runs[run]), self.DONE)

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self.heads[other] < self.heads[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        """(key, run) in order; equal keys by run."""
        while self.heads and self.heads[self.losers[0]] != self.DONE:
            run = self.losers[0]
            yield self.heads[run][1], run
            self.heads[run] = self._next(run)
            self._play(run)


def _merge(batches):
    """A range's captures come run by run, each sorted; they leave in one order."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    runs = rows.column("run").to_pylist()
    starts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
    at = [a if a is not None else -(1 << 63) for a in rows.column("page_id").to_pylist()]
    keys = list(zip(rows.column("surt").to_pylist(), rows.column("capture").to_pylist(), at, range(len(runs)), strict=True))
    order = [key[3] for key, _ in LoserTree([keys[a:b] for a, b in zip(starts, starts[1:], strict=False)])]
    yield from rows.take(pa.array(np.array(order, np.int64))).to_batches(max_chunksize=10_000)


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of (URL key, time, page_id): partitions are ranges, each merged from its runs. The index rows
    are written first, since both their number and the ranges' bounds are taken from them; equal keys are cut by their place."""
    captures = materialize(captures, "warc-runs")
    ranges = max(shuffle_partitions(captures.sparkSession), -(-captures.count() // range_rows))
    cut = captures.repartitionByRange(ranges, "surt", "capture", "page_id", "run", "place")
    return cut.sortWithinPartitions("run", "surt", "capture", "page_id", "place").mapInArrow(_merge, CAPTURES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return merge_index(read_archives(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, unhex(sha1(html)) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(8), lambda g: lpad(bin(('0x' || substr(sha1(html), (5 * g + 1)::INT, 5))::BIGINT), 20, '0')), 'string_agg', '') AS bits FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT))) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
