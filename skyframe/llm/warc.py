"""WARC archives and their capture index.

Writing. Every page becomes a record: a ``response`` with its payload, or a ``revisit`` of the
response that has an equal payload. Of the pages with equal payloads of at least
``min_bytes`` the one with the smallest id is the response. Every record is a gzip member of its
own, so that it can be read from its place in the file. Files are written by Spark's text
writer, one per task, so a lost executor's task is simply written again. What stands between two
records is an empty gzip member with a comment that no record can hold (the archives' mark,
drawn anew for each set of archives): other readers see nothing there, ours split the files at it.

Reading. Files are split at the mark, however large they are. Headers are parsed and checked: the
block must have the stated length, and the digest of a response's payload must be the stated one;
anything else is an error. ``fetch`` reads single records by the places that the index gives.

Archives of others. ``read_warc`` reads any WARC 1.x file, plain, gzipped as a whole or record by
record, as a stream of its records by their Content-Length, with the place of each in its file.
It gives the same columns, so foreign captures go into the same index. Each file is one task's
stream, of which it holds one record at a time.

Index. The captures read from each part of the archives are sorted into a run and written.
Runs are dealt by ranges of (URL key, time, id) of about ``RANGE_ROWS`` entries, however many there
are in all (an entry's number makes its key unique, so no key can fill a range), and each range
merges its slices of the runs with a loser tree. The result is globally ordered by URL key and time.

Defined cases: a null payload is the empty one, and empty payloads are equal to each other;
rows with a null id are responses that nothing refers to; rows that repeat an id with an equal
payload are of the same type; a null URL is left out of the record and sorts first; line
breaks in URLs are percent-encoded, blanks around them dropped, bytes of them that are not
UTF-8 become U+FFFD; a null capture time is the epoch, and times are kept to the second; an empty
table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.session import scratch_path

from .common import materialise, shuffle_partitions

CRLF = "\r\n"
CHUNK = 1 << 20  # bytes read at once
BATCH_BYTES = 16 * CHUNK  # of blocks in a batch that a task returns, about
RANGE_ROWS = 100_000  # index entries that a merging task holds, about
PLACE = "X-Member-Offset"  # field of our records: where the record's gzip member begins in its file
# fixed values: digits of base 32 as Spark's conv writes them, and as RFC 4648 does
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Five hex digits are 20 bits, four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), CONV_DIGITS, BASE32)


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, lower case, without scheme and port."""
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.reverse(F.split(F.lower(F.regexp_extract(url, shape, 1)), r"\."))
    key = F.concat(F.array_join(host, ","), F.lit(")"), F.lower(F.regexp_extract(url, shape, 2)))
    return F.when(url.isNull(), F.lit("")).when(F.regexp_extract(url, shape, 1) == "", F.lower(url)).otherwise(key)


def with_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, captured, payload, n, digest, first): first is the id of the page whose
    payload stands for this one, or null for payloads that no smaller id has."""
    rows = pages.select("page_id", "url", "captured", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha"))
    firsts = materialise(
        rows.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "n")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where(F.col("first") < F.col("last")).select("sha", "first"), "warc-firsts")
    return (rows.join(firsts, "sha", "left")
            .withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first")))
            .withColumn("digest", base32_sha1(F.col("payload"))))


def new_mark() -> bytes:
    """An empty gzip member with a comment of its own (flag 16: a comment follows the header)."""
    return b"\x1f\x8b\x08\x10\0\0\0\0\0\xff" + uuid.uuid4().hex.encode() + b"\0" + b"\x03\0" + bytes(8)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write (page_id, url, html, captured) under ``path``; returns the archives' mark (its bytes as
    ISO-8859-1)."""
    mark = new_mark()
    seconds = F.unix_seconds(F.coalesce(F.col("captured"), F.timestamp_seconds(F.lit(0))))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    date = F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def name(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    def field(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(CRLF)), F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    field("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col("page_id"))), field("WARC-Target-URI", safe_url),
        field("WARC-Date", date),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, field("WARC-Refers-To", name(F.col("first")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0  # a task writes one file
        for batch in batches:
            out, size = [], 0
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = b"".join([zipper.compress(head), zipper.compress(b"%s: %d\r\n\r\n" % (PLACE.encode(), place)),
                                   zipper.compress(block), zipper.compress(b"\r\n\r\n"), zipper.flush()])
                place += len(member) + len(mark)
                size += len(member)
                out.append(member)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = with_types(pages, min_bytes).select(head.cast("binary").alias("head"), block.cast("binary").alias("block"))
    (members.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write
     .options(lineSep=mark.decode("latin-1"), encoding="ISO-8859-1", compression="none", maxRecordsPerFile=0).text(path))
    return mark.decode("latin-1")


CAPTURES = T.StructType([T.StructField(n, t) for n, t in (
    ("url", T.StringType()), ("date", T.StringType()), ("record_type", T.StringType()), ("record_id", T.StringType()),
    ("refers", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()),
    ("payload", T.BinaryType()), ("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))])


def _sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _capture(fields: dict[str, str], block: bytes) -> tuple:
    """Columns of a record up to its payload. The payload is what follows the HTTP header, or the
    whole block if it holds no HTTP message; revisits have none."""
    kind = fields.get("warc-type", "")
    http = fields.get("content-type", "").startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "revisit":
        told = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", head)
        digest, n, body = stated, int(told[1]) if told else None, None
    else:
        digest, n = _sha1(body), len(body)
    return (fields.get("warc-target-uri"), fields.get("warc-date"), kind, fields.get("warc-record-id"),
            fields.get("warc-refers-to"), digest, n, body)


def _own_capture(member: bytes, archive: str) -> tuple:
    """``_capture`` of one of our records, which must be whole and hold what it says, and its place."""
    try:
        unzip = zlib.decompressobj(31)
        record = unzip.decompress(member)
        (_, fields, block), = warc_records(io.BytesIO(record))
        place = int(fields[PLACE.lower()])
        if not unzip.eof or unzip.unused_data or len(record) != record.index(b"\r\n\r\n") + len(block) + 8:
            raise ValueError("not of the stated length")
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"damaged record in {archive}: {e}") from e
    row = _capture(fields, block)
    if row[2] != "revisit" and row[5] != fields.get("warc-payload-digest", "").rpartition(":")[2]:
        raise ValueError(f"wrong payload digest in {archive} at {place}")
    return (*row, archive, place, len(member))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[7] or b"")
        if size > BATCH_BYTES or len(some) >= 1000:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows), CAPTURES)],
                                      names=CAPTURES.names)


def _named(rows: DataFrame) -> DataFrame:
    def page(name: str) -> Column:
        return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    return rows.select(page("record_id").alias("page_id"), "url", F.try_to_timestamp("date").alias("time"), "record_type",
                       page("refers").alias("refers_to"), "payload_digest", "payload_bytes", "payload", "archive", "offset",
                       "length")


def read_archives(spark: SparkSession, path: str, mark: str, payloads: bool = True) -> DataFrame:
    """Captures: page_id, url, time, record_type, refers_to, payload_digest, payload_bytes, payload (null for
    revisits, and for all without ``payloads``), archive (the file), and offset and length of the record in it."""
    raw = (spark.read.options(lineSep=mark, encoding="ISO-8859-1").text(path)
           .select(F.col("value").cast("binary").alias("member"), F.col("_metadata.file_name").alias("archive")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for member, archive in zip(batch.column(0), batch.column(1)):
                    row = _own_capture(member.as_py(), archive.as_py())
                    yield row if payloads else (*row[:7], None, *row[8:])

        yield from _batches(rows())

    return _named(raw.mapInArrow(run, CAPTURES))


def fetch(captures: DataFrame, path: str) -> DataFrame:
    """Rows of ``read_archives`` for ``captures`` (archive, offset, length; other columns are ignored): each record is read from
    its place in the archives under ``path`` alone. Rows that repeat are read once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            files, base = _file_system(path)
            name, stream = None, None
            for batch in batches:
                for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if archive != name:  # rows come sorted by file
                        if stream is not None:
                            stream.close()
                        name, stream = archive, files.open_input_file(f"{base}/{archive}")
                    yield _own_capture(stream.read_at(length, offset), archive)
            if stream is not None:
                stream.close()

        yield from _batches(rows())

    wanted = captures.select("archive", "offset", "length").repartition(shuffle_partitions(captures.sparkSession))
    return _named(wanted.sortWithinPartitions("archive", "offset").mapInArrow(run, CAPTURES))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class _Bytes:
    """Bytes of a WARC file, unzipped where it is gzipped, read in order."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at = stream, b"", 0  # at: place of the buffer's begin
        self.packed, self.member, self.zipped = b"", 0, None  # member: place of the gzip member being read
        self.read_from = 0
        self.unzip = None

    def _more(self) -> bool:
        chunk = self.packed or self.stream.read(CHUNK)
        self.packed = b""
        if not chunk:
            if self.unzip is not None and not self.unzip.eof:
                raise ValueError("the archive ends within a gzip member")
            return False
        if self.zipped is None:
            self.zipped = chunk[:2] == b"\x1f\x8b"
        if not self.zipped:
            self.buffer += chunk
            return True
        if self.unzip is None or self.unzip.eof:
            self.unzip, self.member = zlib.decompressobj(31), self.read_from
        self.buffer += self.unzip.decompress(chunk)
        self.packed = self.unzip.unused_data
        self.read_from += len(chunk) - len(self.packed)
        return True

    def place(self) -> int:
        """Place of the record that begins here: of its gzip member, or of its first byte."""
        while not self.buffer and self._more():
            pass
        return self.member if self.zipped else self.at

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                break
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        self.at += min(n, len(whole))
        return whole[:n]

    def line(self) -> bytes:
        while b"\n" not in self.buffer and self._more():
            pass
        end = self.buffer.find(b"\n")
        return self.take(end + 1 if end >= 0 else len(self.buffer))


def warc_records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records of one file; field names in lower case, of a repeated one
    the first."""
    source = _Bytes(stream)
    while True:
        place, line = source.place(), source.line()
        while line in (b"\r\n", b"\n"):
            place, line = source.place(), source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {place}")
        fields: dict[str, str] = {}
        while (line := source.line().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), value.strip(" \t"))
        length = int(fields["content-length"])
        block = source.take(length)
        if len(block) < length:
            raise ValueError(f"the record at {place} is cut off")
        yield place, fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all WARC files under ``path``, with the columns of ``read_archives`` (``length`` is the block's). Transfer
    codings are not undone. Page ids are those that archives of this library name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    files, name = _file_system(uri)
                    with files.open_input_stream(name, compression=None) as stream:
                        for place, fields, block in warc_records(stream):
                            url, *rest = _capture(fields, block)
                            yield ((url or "").strip("<>") or None, *rest, uri.rpartition("/")[2], place, len(block))

        yield from _batches(rows())

    paths = spark.read.format("binaryFile").load(path).select("path")  # the content is not read here
    n = max(1, min(paths.count(), 1 << 16))
    return _named(paths.repartition(n, "path").mapInArrow(run, CAPTURES))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[tuple[int, int]], keys: list):
        self.keys, self.next, self.stop = keys, [a for a, _ in runs], [b for _, b in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        self.winner = -1
        for run in range(len(runs)):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.next[a] >= self.stop[a] or self.next[b] >= self.stop[b]:
            return self.next[b] >= self.stop[b] and (self.next[a] < self.stop[a] or a < b)
        x, y = self.keys[self.next[a]], self.keys[self.next[b]]
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        node = (run + self.size) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:  # still being built: wait here for the other side
                self.losers[node] = run
                return
            if self._beats(rival, run):
                self.losers[node], run = run, rival
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator[int]:
        while self.winner >= 0 and self.next[self.winner] < self.stop[self.winner]:
            run = self.winner
            yield self.next[run]
            self.next[run] += 1
            self._play(run)


def ascending_runs(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] < keys[i - 1]], len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


ORDER = ("url_key", "time", "page_id", "archive", "number")


def sorted_runs(captures: DataFrame) -> DataFrame:
    """Written index entries, each file a run sorted by URL key and time."""
    entries = (captures.withColumn("url_key", url_key(F.col("url"))).drop("payload")
               .withColumn("number", F.monotonically_increasing_id()))
    return materialise(entries.sortWithinPartitions(*ORDER), "warc-runs")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures ordered by URL key and time: partitions are ranges, each one merged."""
    n = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        parts = [table.column(c).to_pylist() for c in ("url_key", "time", "page_id", "archive", "number")]
        keys = [(k, t, i is not None, i or 0, a, m) for k, t, i, a, m in zip(*parts)]
        order = list(LoserTree(ascending_runs(keys), keys))
        yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)

    return runs.repartitionByRange(n, *ORDER).mapInArrow(run, runs.schema)


def archive_and_index(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and return the merged capture index, with each record's place."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc-archives")
    mark = write_archives(pages, path, min_bytes)
    return merge_runs(sorted_runs(read_archives(spark, path, mark, payloads=False)))
