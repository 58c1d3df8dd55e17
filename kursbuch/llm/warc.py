"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import attach, new_folder, shuffle_partitions, stage, text_or_empty

#: Index lines of a compressed block.
BLOCK_LINES = 256
#: Level of the record and block compression.
LEVEL = 4
CRLF = b"\r\n"
#: Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "about:invalid"
_PRINTABLE = "".join(map(chr, range(33, 127)))


def url_key(url: str | None) -> str:
    """The url with its host reversed by labels, so a site's captures lie together: com,example)/path."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = ",".join(reversed(rest[:cut].lower().split(".")))
    return f"{host}){rest[cut:]}"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def _member(head: list[str], block: bytes) -> bytes:
    data = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + CRLF + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: kursbuch\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, has_ref: bool, date: str) -> bytes:
    """One record as a gzip member: an HTTP response, or a revisit with the response's header alone.

    Control characters, spaces and letters beyond ASCII in a url are written percent-encoded; a null url as
    about:invalid. The page's number, the payload's length and the page referred to are extension fields."""
    head = [
        f"WARC-Type: {'revisit' if has_ref else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {NO_URL if url is None else quote(url, safe=_PRINTABLE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"X-Page-ID: {json.dumps(page_id)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if has_ref:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, http if has_ref else http + payload)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that the workers can write: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else f"file://{uri[5:]}")


def _name(kind: str) -> str:
    """A file of this attempt of this task: a repeated attempt writes another, and the index
    knows only the files of attempts that succeeded."""
    t = TaskContext.get()
    return f"{kind}-{t.partitionId():06d}-{t.taskAttemptId()}"


def with_references(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload, digest, refers_to, has_ref. Of equal payloads of at least min_bytes the row with the
    largest id is the response; rows that repeat that id and payload are responses as well."""
    payload = text_or_empty(html_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha")
    )
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("largest"), F.count("*").alias("n"))
    same = stage(same.filter("n > 1 and largest is not null").select("sha", "largest"), "payloads")
    out = attach(rows, same, ["sha"], F.xxhash64("id"), 64)
    has_ref = F.coalesce(F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest")), F.lit(False))
    return out.withColumn("has_ref", has_ref).drop("sha")


def write_archive(
    pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes the archives and their index to folder; gives the sparse directory.

    Each task writes one archive of gzip members, and yields for each record its url key, file,
    offset and length. These lines are sorted by url key over all tasks and written in
    compressed blocks of BLOCK_LINES; the directory has one row for each block: first_key, last_key, file,
    offset, length, lines. Null html is an empty payload; null urls have an empty key.
    """
    spark = pages.sparkSession
    ship(spark)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, sink, at = _name("part") + ".warc.gz", None, 0
        for batch in batches:
            keys, offsets, lengths = [], [], []
            ids, urls, payloads, largest, refs = (batch.column(c) for c in ("id", "url", "payload", "largest", "has_ref"))
            for i in range(batch.num_rows):  # one payload at a time
                if sink is None:
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    at = sink.write(info(name, date))
                payload, url = payloads[i].as_py().encode("utf-8", "replace"), urls[i].as_py()
                data = record(ids[i].as_py(), url, payload, sha1_base32(payload), largest[i].as_py(), refs[i].as_py(), date)
                sink.write(data)
                keys.append(url_key(url))
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), batch.column("id"), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["url_key", "id", "file", "offset", "length"],
            )
        if sink is not None:
            sink.close()

    rows = with_references(pages, min_bytes, id_col, url_col, html_col)
    lines = rows.select("id", "url", "payload", "largest", "has_ref").mapInArrow(archive, "url_key string, id long, file string, offset long, length long")
    lines = stage(lines, "captures")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, sink, at = _name("index") + ".cdx", None, 0
        held: list[dict] = []

        def flush(rows: list[dict]) -> dict:
            nonlocal at, sink
            sink = sink or fs.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps([r["url_key"], r["id"], r["file"], r["offset"], r["length"]]) for r in rows).encode(), LEVEL)
            sink.write(data)
            entry = {"first_key": rows[0]["url_key"], "last_key": rows[-1]["url_key"], "file": name, "offset": at, "length": len(data), "lines": len(rows)}
            at += len(data)
            return entry

        for batch in batches:
            held += batch.to_pylist()
            full = len(held) // BLOCK_LINES * BLOCK_LINES
            out = [flush(held[i : i + BLOCK_LINES]) for i in range(0, full, BLOCK_LINES)]
            held = held[full:]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_directory)
        if held:
            yield pa.RecordBatch.from_pylist([flush(held)], schema=_directory)
        if sink is not None:
            sink.close()

    # A url with very many captures fills blocks of its own: the id and place break ties.
    ordered = lines.repartitionByRange("url_key", "id", "file", "offset").sortWithinPartitions("url_key", "id", "file", "offset")
    return stage(ordered.mapInArrow(blocks, "first_key string, last_key string, file string, offset long, length long, lines int"), "directory")


_directory = pa.schema(
    [("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())]
)
_result = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
)


class _Files:
    """Open files by name, a few at a time."""

    def __init__(self, folder: str):
        self.fs, self.path = _open(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.get(name)
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            f = self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return f.read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def _row(member: bytes, with_payload: bool) -> dict:
    fields, block = parse(member)
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    payload = block.partition(CRLF + CRLF)[2]
    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != size):
        raise ValueError(f"the payload of page {fields['X-Page-ID']} is damaged")
    ref, url = fields.get("X-Refers-To-Page"), fields["WARC-Target-URI"]
    return {
        "page_id": json.loads(fields["X-Page-ID"]), "url": None if url == NO_URL else url, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": int(ref) if ref else None, "payload": payload.decode() if with_payload and kind == "response" else None,
    }


def _lines(files: _Files, file: str, offset: int, length: int) -> list[list]:
    """The index lines of a block: url_key, id, file, offset, length, ordered."""
    return [json.loads(x) for x in zlib.decompress(files.read(file, offset, length)).decode().split("\n")]


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_place = pa.schema([("url_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def find(spark: SparkSession, folder: str, directory: DataFrame, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """The captures of all url keys of a table (column ``url_key``), each capture once, as read_archive gives them.

    The keys are dealt by range and sorted. For a batch of them a task reads that range of the directory
    and finds the blocks of each key in it by binary search. Then keys are dealt by block: a
    block is read once, its lines are searched in the same way, and the records are read by range. A url
    with very many captures has many blocks, which go to many tasks."""
    ship(spark)
    table = getattr(directory, "_kursbuch_folder", None) or getattr(stage(directory, "directory"), "_kursbuch_folder")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(table)
        blocks = pads.dataset(path, filesystem=fs, format="parquet")
        for batch in batches:
            wanted = batch.column("url_key").to_pylist()
            if not wanted:
                continue
            here = (pc.field("last_key") >= wanted[0]) & (pc.field("first_key") <= wanted[-1])
            part = blocks.to_table(filter=here).sort_by([("first_key", "ascending"), ("last_key", "ascending")])
            first, last = part["first_key"].to_pylist(), part["last_key"].to_pylist()
            at, own = [], []
            for key in wanted:
                i = bisect_left(last, key)
                while i < len(first) and first[i] <= key:
                    at.append(i)
                    own.append(key)
                    i += 1
            found = part.take(pa.array(at, pa.int64())).select(["file", "offset", "length"])
            yield from found.add_column(0, "url_key", pa.array(own, pa.string())).cast(_place).to_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, block, wanted = _Files(folder), None, []

        def records() -> pa.RecordBatch:
            lines = _lines(files, *block)
            keys = [x[0] for x in lines]
            some = [x for key in wanted for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
            some.sort(key=lambda x: (x[2], x[3]))
            return pa.RecordBatch.from_pylist([_row(files.read(f, o, n), with_payload) for _, _, f, o, n in some], schema=_result)

        for batch in batches:
            for row in batch.to_pylist():
                place = (row["file"], row["offset"], row["length"])
                if place != block:
                    if block:
                        yield records()
                    block, wanted = place, []
                wanted.append(row["url_key"])
        if block:
            yield records()
        files.close()

    ordered = keys.select("url_key").distinct().repartitionByRange("url_key").sortWithinPartitions("url_key")
    places = ordered.mapInArrow(search, "url_key string, file string, offset long, length long")
    # A given number: keys and places are few bytes, and by these a few tasks would read everything.
    dealt = places.repartition(shuffle_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset", "url_key")
    return dealt.mapInArrow(read, _ROW)


def read_archive(spark: SparkSession, folder: str, directory: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every capture, read back through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (of responses, if asked for). Digests and lengths are checked against the bytes.

    Index blocks are dealt to the tasks; each reads its blocks and then the records by range,
    in the order of their files."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            for b in batch.to_pylist():
                lines = _lines(files, b["file"], b["offset"], b["length"])
                lines.sort(key=lambda x: (x[2], x[3]))
                yield pa.RecordBatch.from_pylist([_row(files.read(f, o, n), with_payload) for _, _, f, o, n in lines], schema=_result)
        files.close()

    # A given number: the directory is small, and by its bytes a few tasks would read everything.
    dealt = directory.repartition(shuffle_partitions(spark), F.col("file"), F.col("offset"))
    return dealt.mapInArrow(read, _ROW)


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back by their urls, through the index.

    Null html is an empty payload, null urls share the empty key, null ids and repeated rows are captures of
    their own, and payloads of any length go one at a time. An empty table gives no rows."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    directory = write_archive(pages, folder, min_bytes, id_col, url_col, html_col)

    @F.arrow_udf("string")
    def key(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u.as_py()) for u in urls], pa.string())

    keys = pages.select(key(F.col(url_col).cast("string")).alias("url_key"))
    return find(spark, folder, directory, keys).drop("payload", "url")
