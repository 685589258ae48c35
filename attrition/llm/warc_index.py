"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member (a WARC record) in an archive file of
its task, in the shared folder.  Of pages with equal payloads (by SHA-1, at least
``MIN_REVISIT`` bytes) the one with the largest id is a response, the others are
revisit records without the payload.

Index: captures are sorted by their reversed-host URL key and written in
compressed blocks of ``BLOCK_ENTRIES``; each index file ends with its sparse
directory (first key, offset and length of every block).  Ranges are cut on key
and page id, so one very frequent URL spreads over files.

Look-up: the files' first and last keys choose the files, a binary search of the
file's directory chooses the block, and only that block and the record's own
bytes are read, each by a range read through ``pyarrow.fs``, which opens local
paths and the stores of a URI (hdfs, s3, gs).

A task names its file by a random id and only rows that the task returned point
to it, so files of failed or repeated attempts are never read.

Defined results: a null html is an empty payload; a null url has the key "" and
no target URI; a null page id is kept (as response if its payload is
unique among those with an id, else as revisit); rows that share the largest id
are all responses; very long pages are records like any other; an empty table
gives no files and an empty result."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, shared_folder, stored

MIN_REVISIT = 1000
BLOCK_ENTRIES = 512
#: A task starts a new archive file beyond this size.
ARCHIVE_BYTES = 256 << 20
GZIP_LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes of records that a task reads back.
FETCH_BYTES = 32 << 20
CAPTURE = "surt string, url string, page_id {key}, file string, offset bigint, length bigint"


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query; without
    scheme, user and fragment; host in lower case.  A URL without host keeps its
    text after a closing bracket; a null URL has the empty key."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?:]*)", 1))
    tail = F.regexp_replace(rest, r"^[^/?:]*", "")
    return F.when(url.isNull(), "").when(host == "", F.concat(F.lit(")"), bare)).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _escaped(url: str) -> str:
    """A header value can't hold control characters."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = DATE) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
            "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record length doesn't match its header")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


def _gzip(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def choose_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to).  Only digests are aggregated; the join
    has one row per repeated digest on its right side, so a digest that many
    pages share is split by the adaptive join."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    repeated = (rows.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest")
                .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response"))
    return rows.withColumn("digest", digest).join(repeated, "digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE, **columns) -> DataFrame:
    """Writes the archives; returns the captures (a stored table)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                offsets, lengths, files = [], [], []
                # row by row: payloads of a batch are not all copied at once
                for i in range(batch.num_rows):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = _gzip(record(*(batch.column(c)[i].as_py() for c in (0, 1, 3, 4)), date))
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    files.append(name)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), batch.column(0), pa.array(files, pa.string()),
                                                  pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                                                 names=["surt", "url", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    chosen = choose_revisits(pages, **columns)
    kind = chosen.schema["page_id"].dataType.simpleString()
    return stored(arrow_map(chosen.select("page_id", "url", surt(F.col("url")).alias("surt"), "payload", "refers_to"), run, CAPTURE.format(key=kind)), "warc-captures")


@dataclass(frozen=True)
class IndexFile:
    """An index file as the top level knows it."""
    name: str
    first: str
    last: str
    directory: int
    size: int


@dataclass(frozen=True)
class CaptureIndex:
    """Folders of archives and index, and the index files in key order.  The list
    has one entry per index file, a few thousand for a very large archive."""
    archives: str
    folder: str
    files: tuple[IndexFile, ...]
    key: str

    def files_of(self, key: str) -> range:
        """Numbers of the files whose key range holds ``key``."""
        return range(bisect.bisect_left([f.last for f in self.files], key), bisect.bisect_right([f.first for f in self.files], key))


def build_index(captures: DataFrame, archives: str, folder: str, block_entries: int = BLOCK_ENTRIES) -> CaptureIndex:
    """Sorts the captures and writes the index files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, out, at, directory, block, first, last = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None, ""

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(e) for e in block).encode())
            out.write(data)
            directory.append([block[0][0], at, len(data)])
            at, block = at + len(data), []

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), entry[0]
                block.append(entry)
                last = entry[0]
                if len(block) >= block_entries:
                    flush()
        if out is not None:
            if block:
                flush()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "last": [last], "directory": [at], "size": [at + len(data)]})

    ordered = captures.select("surt", "page_id", "url", "file", "offset", "length").repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    made = stored(arrow_map(ordered, run, "name string, first string, last string, directory bigint, size bigint"), "warc-index-files")
    files = sorted((IndexFile(*r) for r in made.collect()), key=lambda f: (f.first, f.last))
    return CaptureIndex(archives, folder, tuple(files), captures.schema["page_id"].dataType.simpleString())


class IndexReader:
    """An open index file: its directory, and the block read last."""

    def __init__(self, folder: str, file: IndexFile) -> None:
        fs, base = open_fs(folder)
        self.input = fs.open_input_file(f"{base}/{file.name}")
        self.directory = json.loads(zlib.decompress(self._range(file.directory, file.size - file.directory)))
        self.firsts = [d[0] for d in self.directory]
        self.block: tuple[int, list] = (-1, [])

    def _range(self, at: int, n: int) -> bytes:
        self.input.seek(at)
        return self.input.read(n)

    def entries(self, key: str) -> Iterator[list]:
        """All captures of a key: from the block before the first that begins
        with it or later."""
        n = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while n < len(self.firsts) and self.firsts[n] <= key:
            if self.block[0] != n:
                data = zlib.decompress(self._range(*self.directory[n][1:]))
                self.block = n, [json.loads(x) for x in data.split(b"\n")]
            rows = self.block[1]
            for i in range(bisect.bisect_left(rows, key, key=lambda e: e[0]), len(rows)):
                if rows[i][0] != key:
                    break
                yield rows[i]
            n += 1


def look_up(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of each distinct URL key of ``urls``."""
    names = ["surt", "url", "page_id", "file", "offset", "length"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, n) for k in batch.column(0).to_pylist() for n in index.files_of(k)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], names=["surt", "number"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            out: list[list] = []
            for key, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened != number:
                    opened, reader = number, IndexReader(index.folder, index.files[number])
                for s, page_id, address, file, offset, length in reader.entries(key):
                    out.append([s, address, page_id, file, offset, length])
                    if len(out) >= 5000:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    def _rows(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), None, pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) if k else pa.array(c, pa.int64() if index.key == "bigint" else pa.string() if index.key == "string" else pa.int32())
                                           for c, k in zip(columns, kinds, strict=True)], names=names)

    keys = arrow_map(urls.select(surt(F.col(f"`{url}`").cast("string")).alias("surt")).distinct(), route, "surt string, number int")
    # by files, not by the few bytes of the keys, which say nothing of what a task reads
    return arrow_map(keys.repartition(max(1, len(index.files)), "number").sortWithinPartitions("number", "surt"), search, CAPTURE.format(key=index.key))


def fetch(index: CaptureIndex, captures: DataFrame, with_payload: bool = True, fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """Range-reads the records of ``captures``, in file order, about ``fetch_bytes`` of
    them a task, and parses them:
    (page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]).
    A revisit's size and digest are those its headers state of the full payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(index.archives)
        name, source = None, None
        for batch in batches:
            for begun in range(0, batch.num_rows, 256):
                out: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(begun, 256).columns), strict=True):
                    if file != name:
                        name, source = file, fs.open_input_file(f"{base}/{file}")
                    source.seek(offset)
                    warc, http, payload = parse(zlib.decompress(source.read(length), 31))
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = warc["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {warc['WARC-Record-ID']} doesn't match")
                    page = warc["WARC-Record-ID"][len("<urn:x-page:"):-1]
                    row = (page or None, warc.get("WARC-Target-URI"), warc["WARC-Type"],
                           warc["WARC-Refers-To"][len("<urn:x-page:"):-1] if revisit else None,
                           int(http["Content-Length"]) if revisit else len(payload), digest, payload if with_payload and not revisit else None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    wanted = stored(captures.select("file", "offset", "length"), "warc-captures")
    tasks = (wanted.agg(F.sum("length")).first()[0] or 0) // fetch_bytes + 1
    ordered = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    got = arrow_map(ordered, run, "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")
    got = got.withColumns({c: F.col(c).cast(index.key) for c in ("page_id", "refers_to")})
    return got if with_payload else got.drop("payload")


def archive(pages: DataFrame, **columns) -> CaptureIndex:
    """Archives and index of a table of pages, in new folders of the shared folder."""
    spark = pages.sparkSession
    archives, folder = shared_folder(spark, "warc"), shared_folder(spark, "warc-index")
    return build_index(write_archives(pages, archives, **columns), archives, folder)


def archive_table(pages: DataFrame) -> DataFrame:
    """Writes all pages, looks every URL up again and reads the records back."""
    index = archive(pages)
    return fetch(index, look_up(index, pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
