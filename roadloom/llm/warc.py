"""WARC archives with a two-level capture index.

Pages are written as gzip members, one record each, in archives of a bounded size; a payload of 100 bytes or more that
occurs again is written once, as a response, and other pages revisit it. The index sorts captures by their URL with the
host reversed, and keeps them in compressed blocks; a sparse directory holds each block's first key, and a part's first
key stands above it. A look-up searches the parts, then the block directory, then one block, and reads ranges of only those
archives that hold what it found, by positioned reads.

Archives are written by Spark's text writer, one archive a file: an archive's bytes are its only row, and the writer's line
end after it is a zero byte, which gzip readers take as padding. So archives can be on any store that Spark can write.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

LEAST_SHARED, ARCHIVE_BYTES, BLOCK_ENTRIES, PART_ENTRIES = 100, 8 << 20, 256, 20_000
#: The directory of parts has so many rows at most; beyond MOST_PARTS * PART_ENTRIES captures parts grow instead.
MOST_PARTS = 100_000
#: So many of the commonest repeated payloads are joined by broadcast, the others by a shuffle.
MOST_BROADCAST = 50_000
#: Ranges of an archive less than this apart are read at once.
GAP = 1 << 16
_CONTROLS = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """A URL with its host's labels reversed, so that a site's captures sort together: com,example,www)/path?query."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(host.split("."))) + port + ")" + (rest[cut:] or "/")


def _escaped(url: str) -> str:
    return _CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url)


def capture_key(url: str | None, page_id: int | None) -> str:
    """What the index sorts by: the reversed-host URL without control characters, then the page."""
    return surt(url and _escaped(url)) + " " + ("-" if page_id is None else f"{page_id:020d}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, place: str, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member. place tells repeated rows apart; the page's number is a field of its own."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {place}")
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_escaped(refers_url)}")
        payload = b""
    body = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def read_record(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """(page_id, url, payload bytes, digest, type, refers_to) of an uncompressed record; a response's payload is digested anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
    page = lambda name: int(fields[name]) if name in fields else None
    return page("X-Page"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], page("X-Refers-To-Page")


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of the gzip members of an archive."""
    view, at = memoryview(content), 0
    while at < len(view) and view[at] == 0x1F:
        d, out, pos = zlib.decompressobj(31), [], at
        while not d.eof:
            if pos >= len(view):
                raise ValueError("an archive ends within a record")
            out.append(d.decompress(view[pos : pos + 65536]))
            pos += 65536
        end = min(pos, len(view)) - len(d.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def _again(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that more than one of rows(page_id, url, digest, bytes) has: the commonest, to broadcast, and the others."""
    shared = rows.where(F.col("bytes") >= LEAST_SHARED)
    again = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("n"))
    again = stored(again.where("n > 1").select(F.col("digest").alias("_digest"), "first", "first_url", "n"), "payloads")
    if again.count() <= MOST_BROADCAST:
        return again, again.where("false")
    common = stored(again.orderBy(F.desc("n"), "_digest").limit(MOST_BROADCAST), "common-payloads")
    return common, again.join(F.broadcast(common.select("_digest")), "_digest", "left_anti")


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """pages(page_id long, url, html) as archives under path; null html counts as empty.

    No page is shuffled while MOST_BROADCAST payloads or fewer are repeated. Beyond that the commonest still stay where they
    are, and only the other pages are joined by a shuffle, so that no common payload lands in one task.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html")})
    common, others = _again(rows)
    same = F.col("digest") == F.col("_digest")
    refers = (F.col("bytes") >= LEAST_SHARED) & (F.col("first") != F.coalesce("page_id", F.lit(-1)))
    columns = ["page_id", "url", "html", "digest", F.when(refers, F.col("first")).alias("refers_to"), F.when(refers, F.col("first_url")).alias("refers_url")]
    placed = rows.join(F.broadcast(common), same, "left")
    if others.isEmpty():
        placed = placed.select(*columns)
    else:
        rest = placed.where("_digest is null").drop("_digest", "first", "first_url", "n").join(others, same, "left")
        placed = placed.where("_digest is not null").select(*columns).unionByName(rest.select(*columns))

    def build(batches):
        out, size, number, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*batch.columns):
                out.append(record(*(x.as_py() for x in row), f"{part} {number}", date))
                number, size = number + 1, size + len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    placed.mapInArrow(build, "archive binary").select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name), content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), "content")


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The capture index of the archives under path, as blocks: part, block, first_key, entries, data."""

    def captures(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = [(capture_key(r[1], r[0]), name, at, n) for at, n, data in members(content.as_buffer()) for r in [read_record(data)]]
                key, archive, at, n = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(archive, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "archive", "offset", "length"])

    entries = stored(archives(spark, path).mapInArrow(captures, "key string, archive string, offset long, length long"), "captures")
    parts = min(-(-entries.count() // PART_ENTRIES) or 1, MOST_PARTS)

    def blocks(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            data = "\n".join("\t".join(map(str, r)) for r in rows).encode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([rows[0][0]]), pa.array([len(rows)], pa.int32()), pa.array([zlib.compress(data)], pa.binary())], names=["part", "block", "first_key", "entries", "data"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in range(4)))
            while len(held) > BLOCK_ENTRIES:
                yield block(held[:BLOCK_ENTRIES])
                number, held = number + 1, held[BLOCK_ENTRIES:]
        if held:
            yield block(held)

    ordered = entries.repartitionByRange(parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    ordered.mapInArrow(blocks, "part int, block int, first_key string, entries int, data binary").write.parquet(index)


def look_up(keys: DataFrame, index: str) -> DataFrame:
    """keys(key) -> key, archive, offset, length of every capture of each distinct key.

    The parts' first keys reach every task (MOST_PARTS at most); blocks stay where their part is looked up.
    """
    spark = keys.sparkSession
    blocks = spark.read.schema("part int, block int, first_key string, entries int, data binary").parquet(index)
    heads = sorted((r["first"], r["part"]) for r in blocks.groupBy("part").agg(F.min("first_key").alias("first")).collect())
    firsts, numbers = [h[0] for h in heads], [h[1] for h in heads]

    def routed(batches):
        for batch in batches:
            keys, parts = [], []
            for k in batch.column(0).to_pylist():
                # A key's captures may begin in the part before the first that starts with it.
                for i in range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k)):
                    keys.append(k)
                    parts.append(numbers[i])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string())], names=["part", "key"])

    asked = keys.select("key").distinct().mapInArrow(routed, "part int, key string").select("part", F.lit(1).alias("kind"), F.lit(0).alias("block"), "key", F.lit(None).cast("binary").alias("data"))
    met = blocks.select("part", F.lit(0).alias("kind"), "block", F.col("first_key").alias("key"), "data").unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "block", "key")

    def search(batches):
        now, directory, data, held = None, [], [], (-1, [], [])
        for batch in batches:
            out: list[tuple] = []
            for part, kind, _, key, block in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if part != now:
                    now, directory, data, held = part, [], [], (-1, [], [])
                if kind == 0:
                    directory.append(key)
                    data.append(block)
                    continue
                for b in range(max(0, bisect_left(directory, key) - 1), bisect_right(directory, key)):
                    if held[0] != b:
                        rows = [x.split("\t") for x in zlib.decompress(data[b]).decode("utf-8", "surrogatepass").split("\n")]
                        held = (b, [r[0] for r in rows], rows)
                    for r in held[2][bisect_left(held[1], key) : bisect_right(held[1], key)]:
                        out.append((r[0], r[1], int(r[2]), int(r[3])))
            key, archive, at, n = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(archive, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "archive", "offset", "length"])

    return met.mapInArrow(search, "key string, archive string, offset long, length long")


def keys_of(pages: DataFrame) -> DataFrame:
    """The index keys of pages(page_id, url)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.string())], names=["key"])

    return pages.select("page_id", "url").mapInArrow(run, "key string")


def _ranges(ranges: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of sorted (offset, length) with gaps of GAP at most, each of ARCHIVE_BYTES at most or of one range."""
    run: list[tuple[int, int]] = []
    for at, n in ranges:
        if run and (at - sum(run[-1]) > GAP or at + n - run[0][0] > ARCHIVE_BYTES):
            yield run
            run = []
        run.append((at, n))
    if run:
        yield run


def read_ranges(spark: SparkSession, path: str, found: DataFrame, bytes_per_task: int = 16 << 20) -> DataFrame:
    """Records at found(archive, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each archive that found names is opened once by the task that has its ranges, and only these are read, in order.
    Opening is by pyarrow's file systems (local, HDFS, S3, GCS, Azure); where path is in a store that only Spark can read,
    the archives that found names are read whole.
    """
    found = stored(found.select("archive", "offset", "length"), "found")
    if not _opens(path):
        return _read_whole(spark, path, found)
    tasks = -(-(found.agg(F.sum("length")).first()[0] or 0) // bytes_per_task) or 1
    tasks = max(tasks, spark.sparkContext.defaultParallelism)

    def read(batches):
        name, held, file, base, fs = None, [], None, None, None

        def out():
            rows = []
            for run in _ranges(held):
                file.seek(run[0][0])
                data = memoryview(file.read(sum(run[-1]) - run[0][0]))
                rows += [read_record(zlib.decompress(data[at - run[0][0] : at - run[0][0] + n], 31)) for at, n in run]
            return _batch(rows)

        for batch in batches:
            for archive, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if held:
                        yield out()
                    if fs is None:
                        fs, base = pyarrow.fs.FileSystem.from_uri(path)
                    name, held, file = archive, [], fs.open_input_file(f"{base}/{archive}")
                held.append((at, n))
        if held:
            yield out()

    ordered = found.repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, _RECORD)


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(records: list[tuple]) -> pa.RecordBatch:
    page, _, size, digest, kind, refers = zip(*records)
    columns = [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _opens(path: str) -> bool:
    try:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        return fs.get_file_info(base).type == pyarrow.fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError, ImportError):  # no such store, or its client library is not here
        return False


def _read_whole(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """read_ranges() by Spark's own reader, which reads a file whole; archives that found does not name are dropped at once."""
    per_archive = found.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))

    def read(batches):
        for batch in batches:
            for content, ranges in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                yield _batch([read_record(zlib.decompress(view[r["offset"] : r["offset"] + r["length"]], 31)) for r in ranges])

    return archives(spark, path).join(per_archive, "archive").select("content", "ranges").mapInArrow(read, _RECORD)


def archive_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives through the index.

    Null html is an empty payload. Rows that share a payload's smallest page_id are all responses; repeated rows are
    records of their own. Null url and null page_id are kept. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    write_archives(pages, f"{root}/archives")
    write_index(spark, f"{root}/archives", f"{root}/index")
    return read_ranges(spark, f"{root}/archives", look_up(keys_of(pages), f"{root}/index"))
