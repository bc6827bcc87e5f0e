"""WARC archives: written with revisit records for equal payloads, and read by byte ranges.

Writing.  Equal payloads (SHA-256) of at least `least` bytes have one response record, that with the smallest identifier; the
others become revisit records that refer to it.  Each record is a gzip member of its own.  Tasks write one archive each
under a name of their own, renamed when complete.

Reading.  An archive needs no index: it is cut into byte ranges, a row each, which Spark makes and deals out.  A task looks for
gzip's magic bytes from the start of its range, and takes a hit for a member if what follows decodes and begins with a
WARC version line; a hit that doesn't is data that only looks like a header.  A record belongs to the range that its
first byte is in; its end may lie in a later range.

A stored record may itself hold whole records, and a range that begins inside it can't tell them from others.  So each range of an
archive with several is first walked (where) without being parsed, to learn at which byte its last member ends; a range then
begins at the furthest such end of those before it.  What lies inside a member never begins a record, and every record is
read once, whatever the ranges.  Each pass reads a range's bytes once, and what its last member has beyond it.

Archives of other writers.  A record's identifier is read as it stands (record_id); id is the number of those written here, else
null.  Digests are checked by the algorithm they name (SHA-1, SHA-256, MD5, in hexadecimal or base 32); digest_ok says with what result,
and is null where there is none to check.  Records of any type are read: what is HTTP is parted from its head, of all
else the block is the payload.  Identifiers of pages are whole numbers.

URLs are written as they are.  Only one that a header can't hold (with line ends, or white space or angle brackets at its ends) is percent-encoded,
and a header of its own (ENCODED) says so.

Null html counts as empty.  Null identifiers are written as such, never become the response of a group that has others,
and revisit it.  Rows that repeat the smallest identifier with the same payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Spans
from pyspark.sql import functions as F

from .common import column, identifier, new_folder, slices, table, texts
from .tokens import filesystem

MAGIC = re.compile(rb"\x1f\x8b\x08")
#: Fixed value: the profile of revisit records for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"
#: The header of records whose URL had to be encoded.
ENCODED = "X-Target-URI-Encoding"
HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def plan_records(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, refers_to, revisit) of each page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(identifier(pages, id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.select("id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status if revisit else status + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{NO_ID if id_ is None else id_}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        odd = url != url.strip() or not url or any(c in url for c in "\r\n") or (url[:1], url[-1:]) == ("<", ">")
        head += [f"WARC-Target-URI: {quote(url, safe='') if odd else url}"] + ([f"{ENCODED}: percent"] if odd else [])
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{NO_ID if refers_to is None else refers_to}>"] if revisit else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the archives when its rows are asked for: (path, bytes, records), one for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, where = filesystem(folder)
        fs.create_dir(where, recursive=True)
        name = f"{where}/part-{context.partitionId():06d}.warc.gz"
        part = f"{where}/_part-{context.partitionId():06d}-{context.taskAttemptId()}"
        size = records = 0
        with fs.open_output_stream(part) as out:
            for batch in slices(batches):
                own = [column(batch, c).to_pylist() for c in ("id", "url", "digest", "refers_to", "revisit")]
                for payload, (id_, url, digest, refers_to, revisit) in zip(texts(column(batch, "html")), zip(*own)):
                    size += out.write(data := gzip_member(record(id_, url, payload, digest, refers_to, revisit))) or len(data)
                    records += 1
        fs.move(part, name)
        yield pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": records}], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return planned.select("id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(run, "path string, bytes long, records long")


class Window:
    """A part of a file that is read on as needed, each byte once, and let go from the front; pos is the first byte that counts."""

    def __init__(self, file, at: int, step: int = 1 << 18):
        self.file, self.at, self.step, self.data, self.pos = file, at, step, b"", 0
        file.seek(at)

    def more(self) -> bool:
        """Reads on, as much as is held already if that is more than a step; False at the end of the file."""
        held = self.data[self.pos :]
        data = self.file.read(max(self.step, len(held)))
        self.data, self.pos = held + data, 0
        return bool(data)

    def skip(self, n: int) -> None:
        self.pos += n
        self.at += n


def member(window: Window, keep: bool = True) -> tuple[bytes, int] | None:
    """The decoded member at the front of the window (no bytes of it, unless keep) and its length, or None if there is none of a
    WARC record."""
    unpack, out, head, size = zlib.decompressobj(31), [], b"", 0
    try:
        while not unpack.eof:
            if window.pos + size == len(window.data) and not window.more():
                return None  # cut short
            data = window.data[window.pos + size : window.pos + size + (1 << 16)]
            size += len(data)
            data = unpack.decompress(data)
            if len(head) < 5:
                head += data[:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
            if keep:
                out.append(data)
    except zlib.error:
        return None
    return (b"".join(out), size - len(unpack.unused_data)) if len(head) >= 5 else None


def members(file, start: int, end: int, keep: bool = True) -> Iterator[tuple[bytes, int]]:
    """Decoded members that begin in [start, end), and the byte each ends at, found without an index."""
    window = Window(file, start)
    while window.at < end:
        hit = MAGIC.search(window.data, window.pos)
        if hit is None:
            window.skip(max(0, len(window.data) - window.pos - 2))  # magic bytes may lie across two reads
            if not window.more():
                return
            continue
        window.skip(hit.start() - window.pos)
        if window.at >= end:
            return
        if (found := member(window, keep)) is not None:
            window.skip(found[1])
            yield found[0], window.at
        else:
            window.skip(1)


def digest_ok(given: str, data: bytes) -> bool | None:
    """Whether a digest, algorithm:value, is that of the data; None if the algorithm isn't known."""
    name, _, value = given.partition(":")
    make = HASHES.get(name.strip().lower().replace("-", ""))
    if not make:
        return None
    own = make(data)
    return value.strip().lower() == own.hexdigest() or value.strip().upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def number_of(record_id: str | None) -> int | None:
    """The page of an identifier written here."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def parse(data: bytes) -> dict:
    """Headers of a record and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    kind, about = headers.get("warc-type", ""), headers.get("content-type", "")
    http, _, payload = block.partition(b"\r\n\r\n") if about.lower().startswith("application/http") else (b"", b"", block)
    revisit, given = kind == "revisit", headers.get("warc-payload-digest")
    # a revisit's head says how long the payload was
    was = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    url = headers.get("warc-target-uri")
    own_kind, _, value = (given or "").partition(":")
    own = None if revisit else hashlib.sha256(payload).hexdigest()
    if given is None or revisit:
        fine = None
    else:
        fine = value.lower() == own or digest_ok(given, payload) if own_kind == "sha256" else digest_ok(given, payload)
    return {
        "id": number_of(headers.get("warc-record-id")), "record_id": headers.get("warc-record-id"), "url": unquote(url) if url is not None and ENCODED.lower() in headers else url[1:-1] if url and (url[:1], url[-1:]) == ("<", ">") else url,
        "content_type": about or None, "payload": None if revisit else payload, "payload_bytes": (int(was[1]) if was else None) if revisit else len(payload),
        "payload_digest": (value.lower() if own_kind == "sha256" else given) if revisit else own, "digest_ok": fine, "record_type": kind or None,
        "refers_to": number_of(headers.get("warc-refers-to")), "refers_to_id": headers.get("warc-refers-to"),
    }


RECORD = "id long, record_id string, url string, content_type string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean, record_type string, refers_to long, refers_to_id string"
#: The same for Arrow.
FIELDS = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]) for name, kind in map(str.split, RECORD.split(", "))])


#: Bytes of archives for each task, and tasks at most.
TASK_BYTES, TASKS = 256 << 20, 100_000


def read_archives(spark: SparkSession, folder: str, archives: list, split: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """A row for each record of archives (path, bytes), read in ranges of `split` bytes."""
    total = sum(x["bytes"] for x in archives)
    tasks = min(TASKS, max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    files = spark.createDataFrame([(x["path"], x["bytes"]) for x in archives if x["bytes"]], "path string, bytes long")
    cuts = F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {split}"))
    ranges = files.repartition(tasks, "path").withColumn("part", F.explode(cuts)).select("path", "part", (F.col("part") * split).alias("start"), F.least((F.col("part") + 1) * split, F.col("bytes")).alias("end"), (F.col("bytes") > split).alias("several"))
    ranges = ranges.repartition(tasks, "path", "part")

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            out = []
            for path, start, end in zip(*(column(batch, c).to_pylist() for c in ("path", "start", "end"))):
                last = 0
                with fs.open_input_file(path) as file:
                    for _, last in members(file, start, end, keep=False):
                        pass
                out.append(last)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("path", "start", "end")), pa.array(out, pa.int64())], ["path", "start", "end", "last"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start, end in zip(*(column(batch, c).to_pylist() for c in ("path", "start", "end"))):
                with fs.open_input_file(path) as file:
                    out, held = [], 0
                    for data, _ in members(file, start, end):
                        out.append(parse(data) if payloads else parse(data) | {"payload": None})
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=FIELDS)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=FIELDS)

    where = ranges.filter("several").select("path", "start", "end").mapInArrow(ends, "path string, start long, end long, last long")
    before = Spans.partitionBy("path").orderBy("start").rowsBetween(Spans.unboundedPreceding, -1)  # a row for each range of one file
    begin = F.greatest("start", F.coalesce(F.max("last").over(before), F.lit(0)))
    found = where.select("path", begin.alias("start"), "end").filter("start < end").repartition(tasks, "path", "end")
    return ranges.filter("NOT several").select("path", "start", "end").unionByName(found).mapInArrow(run, RECORD)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    archives = write_archives(plan_records(table(spark, sf_dir, "pages")), folder).collect()  # a row for each archive
    out = read_archives(spark, folder, archives, payloads=False)
    damaged = F.raise_error(F.concat(F.lit("a payload doesn't match its digest: "), "record_id")).cast("boolean")
    out = out.filter(F.when(F.coalesce("digest_ok", F.lit(True)), F.lit(True)).otherwise(damaged))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
