"""WARC files: written by partitions, read back in ranges by boundary-chain verification.

A reader's task has a range of a file and can't know whether a record's magic in
it begins a record or stands inside a payload.  So each task emits candidates:
offsets of the magic with the offset of the successor that the header's length
claims.  Inside a range, a candidate's chain is followed by pointer doubling to
its exit, the first offset beyond the range; between ranges, a jump table from
candidate to exit is doubled, round by round, from offset 0 of each file.  Only
records on the chain from the file's start are read; magic inside payloads isn't
on it.  Where a chain meets an offset without a record (a damaged header), the
file's records end there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.common import shared_dir, stored

RANGE_BYTES = 8 << 20
#: What a task reads beyond its range at first; a longer header is read on to its end.
HEADER_BYTES = 64 << 10
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> list[tuple[str, str]]:
    """The header of a url; one with line ends or outer white space is escaped, and a second header says so."""
    if url == url.strip() and not re.search(r"[\r\n]", url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", quote(url, safe="/:?#&=", errors="surrogatepass")), ("X-Escaped", "1")]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one file a partition to ``folder``; (path, size) of the files, stored.

    A page is a response record whose payload is its HTML; a null id, url or
    html is a header left out, and a header that says so.  A task writes under a
    name of its own attempt and moves the whole file into place, so a repeated
    task does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        path = f"{root}/part-{context.partitionId():06d}.warc"
        attempt = f"{root}/_attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        size = 0
        with files.open_output_stream(attempt) as out:
            size += out.write(head := record("warcinfo", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")) or len(head)
            for b in batches:
                for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    headers = [("WARC-Record-ID", f"<urn:page:{i}>")] if i is not None else []
                    headers += _uri(url) if url is not None else []
                    headers += [("X-No-Payload", "1")] if html is None else [("Content-Type", "application/http; msgtype=response")]
                    data = record("response", headers, _HTTP + (html or "").encode("utf-8", "surrogatepass"))
                    out.write(data)
                    size += len(data)
        files.move(attempt, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    own = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stored(own.mapInArrow(write, "path string, size bigint"), "warc-files").withColumn("folder", F.lit(folder))


class _Window:
    """A file's bytes from ``base`` on, read further where a header or block goes on."""

    def __init__(self, f: pa.NativeFile, base: int, size: int) -> None:
        f.seek(base)
        self.f, self.base, self.data = f, base, f.read(size)
        self.last: tuple[int, int, re.Match | None] | None = None

    def reach(self, end: int) -> None:
        if end > len(self.data):
            self.f.seek(self.base + len(self.data))
            self.data += self.f.read(end - len(self.data))

    def header(self, at: int) -> tuple[int, int] | None:
        """(offset of the block, its length) of a record whose magic is at ``at``; None without a header's end or a length."""
        # magic inside an earlier one's header ends where that does, and isn't searched again
        if self.last and self.last[0] <= at <= self.last[1]:
            _, end, m = self.last
        else:
            seek, end, m = at, -1, None
            while (end := self.data.find(b"\r\n\r\n", seek)) < 0:
                seek, had = max(at, len(self.data) - 3), len(self.data)
                self.reach(had + max(HEADER_BYTES, had - at))
                if len(self.data) == had:
                    return None
            m = _LENGTH.search(self.data, at, end + 4)
        if m and m.start() < at:
            m = _LENGTH.search(self.data, at, end + 4)
        self.last = (at, end, m)
        return (end + 4, int(m[1])) if m else None


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / range_bytes) - 1)
    r = files.filter("size > 0").select("folder", "path", "size", F.explode(parts).alias("nth"))
    return r.withColumn("start", F.col("nth") * range_bytes).withColumn("end", F.least(F.col("size"), F.col("start") + range_bytes))


def _spread(r: DataFrame) -> DataFrame:
    return r.repartition(max(1, min(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2, r.count())), "path", "start")


def candidates(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, exit, last): each candidate with where its chain leaves its range.

    ``last`` says that the chain ends in the range: at the file's end, or at an
    offset where no record begins.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                source, _ = pafs.FileSystem.from_uri(row["folder"])
                start, end = row["start"], row["end"]
                with source.open_input_file(row["path"]) as f:
                    w = _Window(f, start, end - start + HEADER_BYTES)
                    at, follows = [], []
                    for m in _MAGIC.finditer(w.data, 0, min(len(w.data), end - start + 9)):
                        if m.start() < end - start and (h := w.header(m.start())):
                            at.append(start + m.start())
                            follows.append(start + h[0] + h[1] + 4)
                if not at:
                    continue
                at, follows = np.array(at, np.int64), np.array(follows, np.int64)
                # doubling: each candidate points to its successor in the range, else to itself
                k = np.minimum(np.searchsorted(at, follows), len(at) - 1)
                inside = at[k] == follows
                jump = np.where(inside, k, np.arange(len(at)))
                while True:
                    further = jump[jump]
                    if (further == jump).all():
                        break
                    jump = further
                out = follows[jump]
                last = (out < end) | (out >= row["size"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(at)), pa.array(at), pa.array(out), pa.array(last)], ["path", "at", "exit", "last"])

    return _spread(_ranges(files, range_bytes)).mapInArrow(scan, "path string, at bigint, exit bigint, last boolean")


def reachable(found: DataFrame) -> DataFrame:
    """(path, at): candidates where the chain from a file's start enters a range.

    Jumps double each round, so a file of r ranges takes about log2 r rounds.  A
    jump is kept only for candidates at which some chain enters a range: the
    tables grow with ranges, not with records.
    """
    leave = found.filter("not last").select("path", "at", F.col("exit").alias("to"))
    enter = leave.select("path", F.col("to").alias("at")).distinct()
    jumps = leave.filter("at = 0").unionByName(leave.filter("at > 0").join(enter, ["path", "at"], "left_semi"))
    exists = found.select("path", F.col("at").alias("to"))
    jumps = stored(jumps.join(exists, ["path", "to"], "left_semi").select("path", "at", "to"), "jumps")
    reached = stored(found.filter("at = 0").select("path", "at").distinct(), "reached")
    count = reached.count()
    while True:
        more = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = stored(reached.unionByName(more).distinct(), "reached")
        new = reached.count()
        if new == count:
            return reached
        count = new
        second = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        # both lengths stay: the reached set holds every entry below the doubled distance
        longer = jumps.join(second, ["path", "to"]).select("path", "at", F.col("beyond").alias("to"))
        jumps = stored(longer, "jumps")


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, type, page_id, url, html) of each record on its file's chain.

    ``files`` has folder, path and size.  A header that a record lacks is null;
    html is null for records that aren't responses or that have no payload.
    Payload bytes that aren't UTF-8 become replacement characters.  An empty
    file has no records; no files give an empty result.  Headers and payloads may
    have any length that one task's memory holds; repeated rows are so many records.
    """
    entries = reachable(stored(candidates(files, range_bytes), "candidates")).withColumn("start", F.floor(F.col("at") / range_bytes).cast("long") * range_bytes)
    todo = _ranges(files, range_bytes).join(entries.withColumnRenamed("at", "entry"), ["path", "start"]).select("folder", "path", "size", "start", "end", "entry")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "type", "page_id", "url", "html"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for row in b.to_pylist():
                source, _ = pafs.FileSystem.from_uri(row["folder"])
                with source.open_input_file(row["path"]) as f:
                    base = row["entry"]
                    w = _Window(f, base, row["end"] - base + HEADER_BYTES)
                    at, out, held = base, [], 0
                    while at < row["end"] and _MAGIC.match(w.data, at - base) and (h := w.header(at - base)):
                        block, length = h
                        w.reach(block + length)
                        data = w.data
                        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at - base : block].decode("utf-8", "replace").split("\r\n")[1:]))
                        kind, page = fields.get("warc-type"), re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
                        html = None
                        if kind == "response" and "x-no-payload" not in fields:
                            body = data[block : block + length]
                            html = body.partition(b"\r\n\r\n")[2].decode("utf-8", "replace")
                        url = fields.get("warc-target-uri")
                        if url is not None and "x-escaped" in fields:
                            url = unquote_to_bytes(url).decode("utf-8", "replace")
                        out.append((row["path"], at, kind, int(page[1]) if page else None, url, html))
                        held += length
                        at = base + block + length + 4
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return _spread(todo).mapInArrow(parse, "path string, offset bigint, type string, page_id bigint, url string, html string")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, n_bytes, digest): pages written as WARC files and read back."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_warc(write_warc(pages, folder)).filter("type = 'response'")
    return records.select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"), F.md5(F.col("html").cast("binary")).alias("digest"))


SQL = "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS digest FROM pages"
