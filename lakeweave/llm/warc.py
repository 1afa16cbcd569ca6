"""WARC archives with a two-level capture index.

*Archives.* Each task writes one WARC/1.1 file, a gzip member for each record, and
says where each record is. Of records with equal payloads the one with the largest
identifier is a ``response``; the others are ``revisit`` records that refer to it and
keep its HTTP head (with the payload's length) but not the payload. A task's file
has a name of its own attempt, and only the rows that Spark commits name files, so a
task that runs again leaves an unread file at worst.

*Index.* Captures are range-partitioned and sorted by their reversed-host URL key
(``com,example,www)/path?query``; ties by identifier, so that one URL with many
captures spreads over partitions). Runs of ``block_lines`` lines are compressed into
blocks of an index file. Beside each index file lies its sparse directory: first key and
place of each block, in order, with an array of positions behind, so that it can be
binary-searched by range reads and is never read whole. The first and last keys of the
index files, one for each task that wrote them, are the only part held in memory. A
lookup bisects those, then a directory, then the one or few blocks, and then reads
ranges of archives. Reading back a revisit record does that for the response it refers to.

Payloads are equal if SHA-256 and length are; SHA-1 is only what records say.

Files go to a folder URI that executors share (file:, hdfs:, s3: ... whatever
pyarrow.fs opens), inputs are read by Spark only.

Defined results: a null payload is empty; a null URL is archived as ``urn:page:<id>``;
a null identifier reads back as null; rows that repeat an identifier and a payload
are alike, so all are responses, and rows that repeat an identifier share a record id;
an empty table gives no record. Only the named
columns are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt, materialize, release, scratch_path, shuffle_partitions

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str):
    """The file system of a folder URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL; a text without ``://`` is its own key."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return head
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].split("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (tail if tail[:1] == "/" else "/" + tail)


def target_of(page_id: str | None, url: str | None) -> str:
    """What a record gives as its target URI."""
    return (url if url is not None else f"urn:page:{page_id or ''}").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, refers_url: str | None = None) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_of(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {target_of(refers_to, refers_url)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    plain = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(plain) + press.flush()


def parse(member: bytes) -> dict:
    """headers, type, page_id, refers_to, url, payload (None for a revisit), payload_bytes, payload_digest of a member."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    strip = lambda name: headers[name][len("<urn:page:") : -1] if name in headers else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    own = headers["WARC-Type"] == "response"
    if own and (len(payload) != said or digest_of(payload) != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return {"type": headers["WARC-Type"], "page_id": strip("WARC-Record-ID"), "refers_to": strip("WARC-Refers-To"), "refers_target": headers.get("WARC-Refers-To-Target-URI"), "url": headers["WARC-Target-URI"], "payload": payload if own else None, "payload_bytes": said, "payload_digest": digest}


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """_id, _sha, refers_to, refers_url of the rows that repeat another row's payload."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    light = materialize(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.octet_length(text).alias("_bytes")), "digests")
    groups = light.groupBy("_sha", "_bytes").agg(F.max("_id").alias("refers_to"), F.max_by(F.struct("_url"), "_id")["_url"].alias("refers_url"), F.count(F.lit(1)).alias("k"))
    again = light.select("_id", "_sha", "_bytes").join(groups.filter((F.col("k") > 1) & (F.col("_bytes") >= min_bytes)).drop("k"), ["_sha", "_bytes"])
    return materialize(again.filter("NOT (_id <=> refers_to) AND refers_to IS NOT NULL").select("_id", "_sha", "refers_to", "refers_url").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per row; returns key, id, archive, offset, length of each."""
    again = revisits(pages, id_col, url_col, html_col, min_bytes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    marked = join_dealt(rows, again, F.expr("id <=> _id AND sha = _sha"), "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        name, at, file = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                file = file or store.open_output_stream(f"{path}/{name}", compression=None)
                out = []
                for page_id, url, payload, refers_to, refers_url in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to", "refers_url"))):
                    page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                    member = record("" if page_id is None else page_id, url, payload.as_py(), refers_to, refers_url.as_py())
                    file.write(member)
                    out.append((url_key(target_of(page_id, url)), page_id, name, at, len(member)))
                    at += len(member)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "id", "archive", "offset", "length"])
        finally:
            if file:
                file.close()

    return materialize(marked.mapInArrow(run, "key string, id string, archive string, offset long, length long"), "captures")


def _line(key: str, *rest) -> str:
    return "\t".join([key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n"), *map(str, rest)])


def _plain(key: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), key)


def _fields(line: str) -> tuple[str, str | None, str, int, int]:
    key, page_id, archive, offset, length = line.split("\t")
    return _plain(key), page_id or None, archive, int(offset), int(length)


DIRECTORY = "first_key string, last_key string, index string, offset long, length long, lines long"


def write_index(captures: DataFrame, folder: str, block_lines: int = 1024) -> DataFrame:
    """Writes the blocks and a directory beside each index file; returns all directories as a table, a row for each block."""
    parts = shuffle_partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        name, at, file, held, keys = f"{uuid.uuid4().hex}.idx", 0, None, [], []

        def block(lines: list[str]) -> tuple:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            file.write(data)
            at += len(data)
            return keys[0], keys[-1], name, at - len(data), len(data), len(lines)

        out = []
        for batch in batches:
            file = file or store.open_output_stream(f"{path}/{name}", compression=None)
            for key, page_id, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "archive", "offset", "length"))):
                held.append(_line(key, "" if page_id is None else page_id, archive, offset, length))
                keys.append(key)
                if len(held) == block_lines:
                    out.append(block(held))
                    held, keys = [], []
        if held:
            out.append(block(held))
        if file:
            file.close()
        if out:
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as side:
                starts = [0]
                for first, _, _, offset, length, _ in out:
                    entry = _line(first, offset, length).encode("utf-8", "surrogatepass")
                    side.write(entry)
                    starts.append(starts[-1] + len(entry))
                side.write(struct.pack(f"<{len(starts)}q", *starts) + struct.pack("<q", len(out)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["first_key", "last_key", "index", "offset", "length", "lines"])

    return materialize(ordered.mapInArrow(run, DIRECTORY), "directory")


def read_range(store, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as file:
        return file.read_at(length, offset)


def captures_of(directory: DataFrame, folder: str) -> DataFrame:
    """All captures of the blocks that ``directory`` names: key, id, archive, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for index, offset, length in zip(*(batch.column(c).to_pylist() for c in ("index", "offset", "length"))):
                lines = zlib.decompress(read_range(store, f"{path}/{index}", offset, length)).decode("utf-8", "surrogatepass").split("\n")
                columns = zip(*map(_fields, lines))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "id", "archive", "offset", "length"])

    return directory.select("index", "offset", "length").mapInArrow(run, "key string, id string, archive string, offset long, length long")


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of ``captures``, read by ranges, each archive by one task in its own order."""
    parts = shuffle_partitions(captures.sparkSession)
    ordered = captures.repartition(parts, "archive", F.expr("offset div 33554432")).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, store.open_input_file(f"{path}/{archive}")
                x = parse(file.read_at(length, offset))
                out.append((x["page_id"] or None, x["payload_bytes"], x["payload_digest"], x["type"], x["refers_to"], x["refers_target"], x["url"], x["payload"] if with_payload else None))
            if out:
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_target", "url", "payload"])
        if file:
            file.close()

    return ordered.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, refers_target string, url string, payload binary")


class Search:
    """Binary search in an index: ``files`` are (first key, last key, name) of the index files, in order."""

    #: Blocks, and records that were looked up, kept at hand.
    KEEP = 16

    def __init__(self, folder: str, files: list[tuple[str, str, str]]):
        self.store, self.path = open_folder(folder)
        self.files, self.lasts = files, [f[1] for f in files]
        self.open: dict = {}
        self.blocks: dict = {}

    def _directory(self, name: str):
        """File, number of blocks and where the array of positions begins."""
        if name not in self.open:
            if len(self.open) >= self.KEEP:
                self.open.pop(next(iter(self.open)))[0].close()
            file = self.store.open_input_file(f"{self.path}/{name}.dir")
            n = struct.unpack("<q", file.read_at(8, file.size() - 8))[0]
            self.open[name] = file, n, file.size() - 8 * (n + 2)
        return self.open[name]

    def _entry(self, name: str, k: int) -> tuple[str, int, int]:
        """First key, offset and length of block ``k``: two range reads."""
        file, _, positions = self._directory(name)
        lo, hi = struct.unpack("<2q", file.read_at(16, positions + 8 * k))
        key, offset, length = file.read_at(hi - lo, lo).decode("utf-8", "surrogatepass").split("\t")
        return _plain(key), int(offset), int(length)

    def _block(self, name: str, offset: int, length: int) -> list[tuple]:
        if (name, offset) not in self.blocks:
            if len(self.blocks) >= self.KEEP:
                self.blocks.pop(next(iter(self.blocks)))
            text = zlib.decompress(read_range(self.store, f"{self.path}/{name}", offset, length)).decode("utf-8", "surrogatepass")
            self.blocks[name, offset] = [_fields(x) for x in text.split("\n")]
        return self.blocks[name, offset]

    def captures(self, key: str) -> Iterator[tuple[str | None, str, int, int]]:
        """(id, archive, offset, length) of the captures of a key, in order of the index."""
        for first, _, name in self.files[bisect.bisect_left(self.lasts, key) :]:
            if first > key:
                return
            lo, hi = 0, self._directory(name)[1]
            while lo < hi:  # the first block that begins with the key or behind it
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if self._entry(name, mid)[0] < key else (lo, mid)
            for k in range(max(0, lo - 1), self._directory(name)[1]):
                start, offset, length = self._entry(name, k)
                if start > key:
                    return
                lines = self._block(name, offset, length)
                for x in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]:
                    yield x[1:]

    def records(self, key: str) -> Iterator[dict]:
        for _, archive, offset, length in self.captures(key):
            yield parse(read_range(self.store, f"{self.path}/{archive}", offset, length))


class Archive:
    """A written archive: folder, directory (a table of all blocks), and the first and last keys of its index files."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame, id_type: str = "bigint"):
        self.spark, self.folder, self.directory, self.id_type = spark, folder, directory, id_type
        # a row for each task that wrote the index
        ends = directory.groupBy("index").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
        self.files = sorted((r["first"], r["last"], r["index"]) for r in ends)

    def lookup(self, url: str) -> Iterator[dict]:
        """The captures of one URL, one by one: keys of index files, directory, blocks, then ranges of archives."""
        return Search(self.folder, self.files).records(url_key(url))


def archive(pages: DataFrame, folder: str | None = None, block_lines: int = 1024, id_col: str = "page_id", **options) -> Archive:
    """Writes archives and index below ``folder`` (a new one in the shared folder if None)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    captures = write_archives(pages, folder, id_col, **options)
    return Archive(spark, folder, write_index(captures, folder, block_lines), pages.schema[id_col].dataType.simpleString())


def resolve(stored: Archive, rows: DataFrame) -> DataFrame:
    """Revisit records with size and digest of the response that they refer to, looked up by the index; raises if it isn't there.

    Rows come in order of the key they look for, so that neighbours need the same blocks.
    """
    folder, files = stored.folder, stored.spark.sparkContext.broadcast(stored.files)  # a row for each index file
    wanted = rows.select("refers_to", "refers_target").distinct()
    parts = shuffle_partitions(stored.spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(folder, files.value)
        for batch in batches:
            out = []
            for page_id, target in zip(*(batch.column(c).to_pylist() for c in ("refers_to", "refers_target"))):
                found = next((x for x in search.records(url_key(target)) if x["page_id"] == page_id and x["type"] == "response"), None)
                if found is None:
                    raise ValueError(f"the response {page_id} of a revisit is not in the archive")
                out.append((page_id, target, found["payload_bytes"], found["payload_digest"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["_id", "_target", "_bytes", "_digest"])
        release()

    key = F.coalesce(F.reverse(F.split(F.regexp_extract("refers_target", "^[^:]*://([^/?#]*)", 1), "[.]")), F.array())
    dealt = wanted.repartitionByRange(parts, key, "refers_target", "refers_to").sortWithinPartitions(key, "refers_target", "refers_to")
    found = materialize(dealt.mapInArrow(run, "_id string, _target string, _bytes long, _digest string"), "responses")
    joined = join_dealt(rows, found, F.expr("refers_to = _id AND refers_target = _target"))
    same = (F.col("payload_bytes") == F.col("_bytes")) & (F.col("payload_digest") == F.col("_digest"))
    checked = F.when(same, F.col("_digest")).otherwise(F.raise_error(F.concat(F.lit("revisit differs from response "), "_id")).cast("string"))
    return joined.withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", checked).select(*rows.columns)


def read_all(stored: Archive, with_payload: bool = False) -> DataFrame:
    """Every record: id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    All blocks of the index are walked; what a revisit says of its payload comes from the response that it refers to.
    """
    rows = materialize(read_records(captures_of(stored.directory, stored.folder), stored.folder, with_payload), "records")
    rows = rows.filter("record_type = 'response'").unionByName(resolve(stored, rows.filter("record_type <> 'response'"))).drop("refers_target")
    return rows.withColumn("id", F.col("id").cast(stored.id_type)).withColumn("refers_to", F.col("refers_to").cast(stored.id_type))
