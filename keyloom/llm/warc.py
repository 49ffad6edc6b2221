"""WARC archives with a two-level capture index.

Writing: each task writes one archive, a gzip member for each record, to the shared folder. Captures of
one payload are found by digest with a pre-aggregated maximum; one is written as a response, the others as
revisits that name it. Index: captures sorted by reversed-host URL key are cut into blocks, each block
compressed; the sparse directory keeps the first key and the place of each block. A lookup searches the
directory by bisection, reads one block by range, and then one record by range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import new_folder, small_batches, written

#: Captures in an index block, and gzip's level for records.
BLOCK_LINES, LEVEL = 512, 4
PREFIX = "urn:keyloom:page:"
CAPTURES = "url_key string, page_id long, file string, start long, size long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: ``https://m.a.org:8/x?q`` -> ``org,a,m:8)/x?q``.

    Scheme, user and fragment don't count, nor do the case of the host and a leading ``www.``. What has no
    host keeps its text; null is empty. White space and control characters are percent-encoded.
    """
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record, uncompressed. A revisit has no block; its payload's length stands in a header of its own."""
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{refers_to}>", f"WARC-Refers-To-Target-URI: {refers_url}"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {a.lower(): b for a, _, b in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    return headers, rest[:n]


def id_of(header: str) -> int | None:
    found = header.strip("<>").removeprefix(PREFIX)
    return int(found) if found else None


def clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write every row as a record below the shared folder; one capture for each: url_key, page_id, file, start, size.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest page_id is a response
    and the others revisit it; rows that repeat both page_id and payload are the same capture, and each is
    written as a response. A row with a null page_id is a response unless another row has its payload.
    A null payload or URL is empty. Files carry the task attempt in their name, and only those of attempts
    whose rows were kept are ever read, so a lost executor leaves no wrong captures.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    p = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = p.groupBy("sha").agg(F.max_by(F.struct(F.col("page_id").alias("to"), F.col("url").alias("to_url")), F.struct("page_id", "url")).alias("f"), F.count("*").alias("n"))
    p = p.join(first.filter("n > 1").select("sha", "f.to", "f.to_url").hint("shuffle_hash"), "sha", "left").select("page_id", "url", "html", "to", "to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        try:
            for b in small_batches(batches):
                rows = []
                for page_id, address, text, to, to_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "to", "to_url"))):
                    payload = text.encode()
                    kind = "revisit" if to is not None and len(payload) >= least and page_id != to else "response"
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = pack.compress(record(kind, page_id, clean(address), payload, payload_digest(payload), to, clean(to_url))) + pack.flush()
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    rows.append((url_key(address), page_id, name, at, len(data)))
                    at += len(data)
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([f"{folder}/{x}" for x in cols[2]], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["url_key", "page_id", "file", "start", "size"])
        finally:
            if out is not None:
                out.close()

    return written(p.mapInArrow(run, CAPTURES), "captures")


def write_index(captures: DataFrame) -> DataFrame:
    """Sort captures by key into compressed blocks; the directory: first (url_key, page_id), file, start, size, n of each."""
    folder = new_folder(captures.sparkSession, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.idx"
        out, at, found, lines = None, 0, [], []

        def block() -> None:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in line) for line in lines).encode())
            out.write(data)
            found.append((lines[0][0], lines[0][1], f"{folder}/{name}", at, len(data), len(lines)))
            at += len(data)
            lines.clear()

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["url_key", "page_id", "file", "start", "size", "n"])

    order = captures.select("url_key", "page_id", "file", "start", "size").repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "start")
    return written(order.mapInArrow(run, "url_key string, page_id long, file string, start long, size long, n long"), "directory")


class Archive:
    """Reads records through the directory: bisection, one block by range, one record by range."""

    def __init__(self, directory: list[tuple]):
        # Blocks that start with one key stay apart by their place.
        self.directory = sorted(directory, key=lambda x: (x[0], -1 << 63 if x[1] is None else x[1], x[2], x[3]))
        self.first = [(x[0], -1 << 63 if x[1] is None else x[1]) for x in self.directory]
        self.at = {(x[2], x[3]): i for i, x in enumerate(self.directory)}
        self.open: dict[str, tuple] = {}
        self.blocks: dict[int, list[tuple]] = {}

    def range(self, file: str, start: int, size: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 64:
                for f in self.open.values():
                    f.close()
                self.open.clear()
            fs, path = filesystem(file)
            self.open[file] = fs.open_input_file(path)
        return self.open[file].read_at(size, start)

    def block(self, i: int) -> list[tuple]:
        """(url_key, page_id, file, start, size) of each capture of a block."""
        if i not in self.blocks:
            if len(self.blocks) >= 64:
                self.blocks.clear()
            _, _, file, start, size, _ = self.directory[i]
            lines = zlib.decompress(self.range(file, start, size)).decode().split("\n")
            self.blocks[i] = [(k, int(p) if p else None, f, int(s), int(n)) for k, p, f, s, n in (x.split("\t") for x in lines)]
        return self.blocks[i]

    def read(self, file: str, start: int, size: int) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.range(file, start, size), 31))

    def find(self, url: str | None, page_id: int | None) -> tuple[dict[str, str], bytes] | None:
        """The record of a capture, by URL and id."""
        key = (url_key(url), -1 << 63 if page_id is None else page_id)
        # Blocks that start with the key, and the one before them, which may end in it.
        for i in range(max(0, bisect_left(self.first, key) - 1), bisect_right(self.first, key)):
            for k, p, file, start, size in self.block(i):
                if k == key[0] and p == page_id:
                    return self.read(file, start, size)
        return None


def _directory(spark: SparkSession, directory: DataFrame) -> str:
    """The directory as one file in the shared folder, for workers to load: one entry for each block of captures."""
    path = new_folder(spark, "sparse")
    directory.select("url_key", "page_id", "file", "start", "size", "n").write.parquet(path)
    return path


def _load(path: str) -> Archive:
    import pyarrow.dataset as ds

    fs, root = filesystem(path)
    t = ds.dataset(root, filesystem=fs, format="parquet").to_table().to_pydict()
    return Archive(list(zip(t["url_key"], t["page_id"], t["file"], t["start"], t["size"], t["n"])) if t else [])


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record, read through the index: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload_ok.

    Length and digest are of the full payload: a revisit's is fetched from the response it names, by
    lookup. payload_ok says that the payload's digest is the one in the record's header.
    """
    sparse = _directory(directory.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _load(sparse)
        full: dict[str, tuple[int, str]] = {}  # of responses that revisits name
        for b in batches:
            for place in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                rows = []
                for _, page_id, file, start, size in archive.block(archive.at[place]):
                    headers, body = archive.read(file, start, size)
                    kind, to = headers["warc-type"], None
                    if kind == "revisit":
                        to = id_of(headers["warc-refers-to"])
                        if headers["warc-refers-to"] not in full:
                            if len(full) > 100_000:
                                full.clear()
                            _, named = archive.find(headers["warc-refers-to-target-uri"], to)
                            full[headers["warc-refers-to"]] = len(named), payload_digest(named)
                        n, digest = full[headers["warc-refers-to"]]
                    else:
                        n, digest = len(body), payload_digest(body)
                    rows.append((id_of(headers["warc-record-id"]), headers["warc-target-uri"], kind, to, n, digest, headers["warc-payload-digest"] == "sha1:" + digest))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload_ok"])

    blocks = directory.select("file", "start").repartition(max(1, directory.sparkSession.sparkContext.defaultParallelism * 2))
    return blocks.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload_ok boolean")
