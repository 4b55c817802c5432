"""WARC archives of pages with a two-level capture index.

Writing: of equal payloads of REVISIT_BYTES or more, the one with the largest page id is stored, the others are revisit
records that name it. Every record is a gzip member of its own in a .warc.gz file.

Index: the captures, sorted by reversed-host key, are cut into compressed blocks of BLOCK lines; a sparse directory
keeps each block's first and last key and its place. A lookup finds the blocks of a key by binary search in its shard of
the directory, reads just these ranges, finds the key's captures in them and reads just their ranges of the archives.

Archives and blocks lie under the shared scratch folder, opened by its URI. A task that is run again writes new files;
only those of the run that counts are named in the tables, so lost executors leave no wrong entry.

Defined cases: a null payload is empty; a null url has the empty key; null page ids are written, revisits included, but
never the target of one; repeated rows are records of their own; an empty table gives empty archives; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.arrow import slices
from voxtable.llm.stored import stored
from voxtable.sources.scratch import scratch_path

REVISIT_BYTES = 1000
BLOCK = 256
FILE_BYTES = 1 << 28
SHARDS = 64
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, file string, offset long, length long"
PLACE = "shard int, first string, last string, file string, offset long, length long, captures long"


def key_of(url: str | None) -> str:
    """The reversed-host key: com,example,blog)/path?query in lower-case host letters, www and port left out."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit has no payload but names the record that has it."""
    kind, name = ("revisit" if revisit else "response"), "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {name}",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "None" else int(number)


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Writer:
    """Appends byte strings to files of about FILE_BYTES in a folder of the shared store."""

    def __init__(self, folder: str, suffix: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.suffix, self.file, self.name, self.at = suffix, None, "", 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.file is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}", 0
            self.file = self.store.open_output_stream(self.name, compression=None)
        self.file.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class Reader:
    """Range reads from files of the store, a few of them held open."""

    def __init__(self, folder: str):
        self.store, _ = fs.FileSystem.from_uri(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def get(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 32:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.store.open_input_file(name)
        return self.open[name].read_at(length, offset)


@dataclass
class Archive:
    """folder; captures and directory: tables of the records' and the blocks' places."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Write a record per row and index them."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    twice = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
             .where("n > 1 and target is not null").select("digest", "target"))
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")) & (F.col("size") >= REVISIT_BYTES)
    typed = rows.join(twice, "digest", "left").select("page_id", "url", "digest", "size", "target", revisit.alias("revisit"), "payload")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, names = Writer(folder, ".warc.gz"), ["page_id", "url", "payload", "digest", "size", "target", "revisit"]
        for batch in slices(batches, "payload"):
            out = []
            for page, url, payload, *rest in zip(*(batch[c].to_pylist() for c in names), strict=True):
                out.append((key_of(url), page, *writer.put(gzipped(record(page, url, payload.encode(), *rest)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                                             ["key", "page_id", "file", "offset", "length"])
        writer.close()

    captures = stored(typed.mapInArrow(fn, CAPTURE), "captures")
    return Archive(folder, captures, index(captures, folder))


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted captures as compressed blocks; the sparse directory of the blocks."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, shard, held = Writer(folder, ".idx"), TaskContext.get().partitionId(), []

        def block(lines: list[tuple]) -> tuple:
            return (shard, lines[0][0], lines[-1][0], *writer.put(zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode())), len(lines))

        def out(places: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*places, strict=True), kinds, strict=True)],
                                              ["shard", "first", "last", "file", "offset", "length", "captures"])

        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)
            whole = len(held) // BLOCK * BLOCK
            if whole:
                yield out([block(held[a:a + BLOCK]) for a in range(0, whole, BLOCK)])
                del held[:whole]
        if held:
            yield out([block(held)])
        writer.close()

    order = ["key", "page_id", "file", "offset"]  # captures of one key may lie in several shards
    return stored(captures.repartitionByRange(SHARDS, *order).sortWithinPartitions(*order).mapInArrow(fn, PLACE), "directory")


def lookup(archive: Archive, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """The records of all captures of the given keys: key, page_id, record_type, refers_to, payload_digest,
    payload_bytes, payload (null for revisits).

    The shards' key ranges (one row a shard) go to all tasks; keys meet their shard's part of the directory in one group.
    """
    folder = archive.folder
    ranges = archive.directory.groupBy("shard").agg(F.min("first").alias("low"), F.max("last").alias("high")).orderBy("low", "high").collect()
    lows, highs, shards = ([r[c] for r in ranges] for c in ("low", "high", "shard"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(shards[k], key) for key in batch["key"].to_pylist() for k in range(bisect_left(highs, key), bisect_right(lows, key))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int32()), pa.array([k for _, k in pairs], pa.string())], ["shard", "key"])

    routed = keys.select(F.col(key_col).alias("key")).where(F.col("key").isNotNull()).distinct().mapInArrow(route, "shard int, key string")

    def search(asked: pa.Table, places: pa.Table) -> pa.Table:
        places = places.sort_by([("first", "ascending"), ("last", "ascending")])
        firsts, lasts = places["first"].to_pylist(), places["last"].to_pylist()
        hit: dict[int, list[str]] = {}
        for key in asked["key"].to_pylist():
            for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                hit.setdefault(k, []).append(key)
        found = places.take(pa.array(list(hit), pa.int64()))
        return pa.table([found["file"], found["offset"], found["length"], pa.array(list(hit.values()), pa.list_(pa.string()))], names=["file", "offset", "length", "keys"])

    blocks = routed.groupBy("shard").cogroup(archive.directory.groupBy("shard")).applyInArrow(search, "file string, offset long, length long, keys array<string>")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for file, offset, length, keys in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length", "keys")), strict=True):
                wanted, out = set(keys), []
                for line in zlib.decompress(reader.get(file, offset, length)).decode().split("\n"):
                    key, _, *place = json.loads(line)
                    if key in wanted:
                        fields, payload = parse(zlib.decompress(reader.get(*place), 31))
                        digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                        out.append((key, page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None,
                                    digest, int(fields["WARC-Payload-Length"]), None if revisit else payload.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["key", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    # A stated count is not coalesced by size: a block's row is small, the records behind it are not.
    return blocks.repartition(SHARDS, "file", "offset").mapInArrow(
        fetch, "key string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string")


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The keys of all rows."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(u) for u in batch["url"].to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(fn, "key string")
