"""WARC archives of pages, a two-level capture index, and reading back through it.

Writing. Equal payloads are found by digest: the one with the smallest page_id is the response, the others are revisit records
that name its record. A task writes the records of its partition, one gzip member each, to one archive in the shared folder.

Index. Lines (key, page_id, archive, offset, length) are range-partitioned by key (the host reversed, then path and query) and
sorted; a task writes its range as gzip blocks of ``BLOCK`` lines and a sparse directory, one entry a block. The top level is
one row per range (its first key): as many as there are partitions.

Reading. A look-up finds its range in the top level, its block by binary search in that range's directory, its line in
the block, and the record by one ranged read. Look-ups come sorted by key, so a task holds one directory and one block.

Files are written under a name of the attempt and then renamed to a name of the partition: a lost executor or a second attempt
leaves whole files only. All access goes through the file system that the shared folder's address names.

Defined cases: a null url is the empty one, a null html an empty payload; a payload of any length is one record, held whole by the task that
writes or reads it; payloads below ``least`` bytes are never revisits; a null
page_id is written and read, and comes before no other id; repeated rows are records of their own, and of equal payloads with
one smallest page_id one row is the response; an empty table makes an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisplit.llm.common import bounded_batches, materialise, work_dir

#: Lines in a block of the index.
BLOCK = 1000
#: Payloads from this size on can be revisits.
LEAST = 0
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LINES = "key string, row string, page_id long, archive string, offset long, length long"
RECORD = "row string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sort_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, a bracket, then the rest: urls of a host, and hosts of a domain, are side by side."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^(?:[^/?#]*:)?//([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"(?s)^(?:[^/?#]*:)?//[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row)}>"


def record(page: dict, payload: bytes) -> bytes:
    """One WARC record; a revisit has no payload but names the digest and length of what it revisits."""
    response = page["record_type"] == "response"
    url = (page["url"] or "").encode("unicode_escape").decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if response else http
    head = [
        "WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: {_record_id(page['row'])}",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{page['payload_digest']}",
        f"X-Payload-Length: {page['payload_bytes']}", f"X-Row: {page['row']}", f"X-Page-ID: {json.dumps(page['page_id'])}",
    ]
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(page['refers_row'])}", "WARC-Refers-To-Date: 2000-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {page['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields and payload; digests and lengths of responses are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    out = {
        "row": fields["X-Row"], "page_id": json.loads(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"].encode().decode("unicode_escape"),
        "record_type": fields["WARC-Type"], "payload": payload, "refers_to": None,
    }
    if out["record_type"] == "response":
        out |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
        if f"sha1:{out['payload_digest']}" != fields["WARC-Payload-Digest"]:
            raise ValueError("a payload differs from its digest")
    else:
        out |= {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
        out["refers_to"] = int(fields["X-Refers-To-Page-ID"])
    return out


class Writer:
    """A file that has its name only once it is whole."""

    def __init__(self, root: str, name: str) -> None:
        self.files, base = open_fs(root)
        self.path, self.own = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.files.create_dir(base, recursive=True)
        self.out, self.at = self.files.open_output_stream(self.own, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        start, self.at = self.at, self.at + len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()
        # A file of that name is another attempt's, over the same rows: it is as good, and may be in use.
        if self.files.get_file_info(self.path).type == fs.FileType.NotFound:
            self.files.move(self.own, self.path)
        else:
            self.files.delete_file(self.own)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """row, page_id, payload_bytes, payload_digest, record_type, refers_to, refers_row of pages (row, page_id, html)."""
    spark = pages.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [(x or "").encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, payloads), pa.int64()), pa.array(map(digest_of, payloads), pa.string())],
                ["row", "page_id", "payload_bytes", "payload_digest"],
            )

    found = pages.select("row", "page_id", "html").mapInArrow(run, "row string, page_id long, payload_bytes long, payload_digest string")
    found = materialise(found, "warc-digests")
    # The first by page_id, then by row: one response for each payload.
    first = found.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    )
    joined = found.join(first, "payload_digest", "left")
    revisit = F.col("first.page_id").isNotNull() & (F.col("payload_bytes") >= least) & (F.col("row") != F.col("first.row"))
    return joined.select(
        "row", "page_id", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.row")).alias("refers_row"),
    )


def write(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Write the archives below root; the lines of the index, as a written table. pages: page_id, url, html."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # A row's own name, the same wherever it is computed: repeated rows share one, and then one record stands for each.
    pages = pages.withColumn("row", F.sha1(F.concat_ws("\x00", F.to_json(F.struct("page_id", "url")), F.sha1(F.coalesce("html", F.lit("null"))))))
    key = F.xxhash64("row")
    numbered = pages.groupBy("row").count().where("count > 1").select("row", "count")
    if not numbered.isEmpty():
        # Repeated rows are told apart by a number.
        times = F.coalesce("count", F.lit(1))
        single = pages.dropDuplicates(["row"]).join(numbered, "row", "left")
        pages = single.withColumn("_i", F.explode(F.sequence(F.lit(1), times))).withColumn("row", F.concat_ws("-", "row", F.col("_i").cast("string"))).drop("_i", "count")
    role = roles(pages, least).drop("page_id")
    whole = pages.withColumn("_k", key).join(role.withColumn("_k", F.xxhash64("row")), ["_k", "row"]).drop("_k").withColumn("key", sort_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"archive-{_partition():06d}.warc.gz", None
        for b in batches:
            lines = []
            for page in b.to_pylist():
                out = out or Writer(root, name)
                raw = record(page, (page["html"] or "").encode())
                start, length = out.add(gzip.compress(raw, LEVEL, mtime=0))
                lines.append({"key": page["key"], "row": page["row"], "page_id": page["page_id"], "archive": name, "offset": start, "length": length})
            yield pa.RecordBatch.from_pylist(lines, _LINE)
        if out:
            out.close()

    ordered = whole.select("key", "row", "page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_row")
    # Sorted by row: a second attempt at a partition writes the same bytes.
    return materialise(ordered.sortWithinPartitions("row").mapInArrow(run, LINES), "warc-lines")


_LINE = pa.schema([("key", pa.string()), ("row", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


@dataclass(frozen=True)
class Index:
    """Where the archives and the index lie, and the top level: (first key and row, name) of each range, sorted."""

    root: str
    top: tuple[tuple[str, str, str], ...]


def build_index(lines: DataFrame, root: str) -> Index:
    """Sorted, compressed blocks and their sparse directories, one pair of files a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, directory, held = f"index-{_partition():06d}", None, [], []

        def flush() -> None:
            start, length = out.add(gzip.compress("\n".join(json.dumps(x) for x in held).encode(), LEVEL, mtime=0))
            directory.append([held[0][0], held[0][1], start, length])
            held.clear()

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "row", "archive", "offset", "length")), strict=True):
                out = out or Writer(root, f"{name}.blocks")
                held.append(x)
                if len(held) >= BLOCK:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            book = Writer(root, f"{name}.directory")
            book.add(json.dumps(directory).encode())
            book.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (directory[0][0], directory[0][1], name)], ["key", "row", "name"])

    ranges = lines.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    top = materialise(ranges.mapInArrow(run, "key string, row string, name string"), "warc-top")
    return Index(root, tuple(sorted((x.key, x.row, x.name) for x in top.collect())))


class Reader:
    """Look-ups through the two levels: the directory and the block used last are kept."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.files, self.base = open_fs(index.root)
        self.firsts = [x[:2] for x in index.top]
        self.range: str | None = None
        self.block: int | None = None
        self.open: dict[str, io.IOBase] = {}

    def _read(self, name: str, start: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) > 32:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.base}/{name}")
        return self.open[name].read_at(length, start)

    def line(self, key: str, row: str) -> tuple[str, int, int]:
        """(archive, offset, length) of a capture."""
        at = bisect_right(self.firsts, (key, row)) - 1
        if at < 0:
            raise KeyError(key)
        name = self.index.top[at][2]
        if name != self.range:
            with self.files.open_input_stream(f"{self.base}/{name}.directory", compression=None) as f:
                self.directory = json.loads(f.read())
            self.blocks, self.range, self.block = [tuple(x[:2]) for x in self.directory], name, None
        at = bisect_right(self.blocks, (key, row)) - 1
        if at < 0:
            raise KeyError(key)
        if at != self.block:
            _, _, start, length = self.directory[at]
            raw = gzip.decompress(self._read(f"{name}.blocks", start, length))
            self.lines, self.block = [json.loads(x) for x in raw.split(b"\n")], at
            self.keys = [tuple(x[:2]) for x in self.lines]
        at = bisect_right(self.keys, (key, row)) - 1
        if at < 0 or self.keys[at] != (key, row):
            raise KeyError(key)
        return tuple(self.lines[at][2:5])

    def record(self, key: str, row: str) -> dict:
        return parse(gzip.decompress(self._read(*self.line(key, row))))


def read(lookups: DataFrame, index: Index) -> DataFrame:
    """The records of (key, row) pairs, each found through the index and read from its archive."""
    shared = lookups.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            reader = reader or Reader(shared.value)
            rows = [reader.record(k, r) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in _RECORD.names} for x in rows], _RECORD)

    ranges = lookups.select("key", "row").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return ranges.mapInArrow(run, RECORD)


_RECORD = pa.schema(
    [("row", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def archive(pages: DataFrame, root: str | None = None, least: int = LEAST) -> tuple[DataFrame, Index]:
    """Write and index pages; the lines of the index and the index."""
    root = root or work_dir(pages.sparkSession, "warc")
    lines = write(pages, root, least)
    return lines, build_index(lines, root)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """What the archives of these pages say when they are read back through the index."""
    lines, index = archive(pages, least=least)
    return read(lines, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
