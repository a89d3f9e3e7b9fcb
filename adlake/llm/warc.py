"""WARC archives in Zstandard: one frame per record, behind a dictionary in a leading skippable frame.

The writer packs records into archives of bounded size. Each starts with the dictionary frame
and holds whole records, so any archive is read alone. Files are written by Spark's text
source, one row a file: its line separator is an empty skippable frame, which readers pass over.
The reader loads the dictionary, walks the frames one by one and checks what each record
says of itself: version, mandatory fields, lengths, closing line ends and payload digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm.common import few_by_rank, stored, to_tasks, zstd_dictionary
from adlake.session import scratch_path

#: Fixed values of the two formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Smaller payloads are always written out.
LEAST_REVISIT = 100
#: Compressed bytes fed to a frame at a time; what lies behind its end is copied, so this stays small.
FEED = 16 << 10
RECORD = ("archive string, at long, record_id string, record_type string, page_id long, target_uri string, "
          "refers_to_id string, declared_digest string, declared_bytes long, payload_digest string, payload binary, error string")


def learned_dictionary(pages: DataFrame, dictionary_bytes: int = 1 << 16, samples: int = 1024, excerpt: int = 4096) -> bytes:
    """A Zstandard dictionary from at most ``samples`` excerpts of pages picked by a hash of their id.

    Empty where there is too little text to learn from; archives then have no dictionary.
    """
    start = F.pmod(F.xxhash64("page_id", "url"), F.greatest(F.length("html") - excerpt, F.lit(0)) + 1) + 1
    rows = pages.filter(F.length("html") > 0).withColumn("rank", F.xxhash64("page_id", "url"))
    found = (few_by_rank(rows, rows.count(), samples)
             .select("rank", F.substr("html", start.cast("int"), F.lit(excerpt)).alias("cut"))
             .orderBy("rank", "cut").limit(samples).collect())
    return zstd_dictionary([r["cut"].encode() for r in found], dictionary_bytes)


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, size: int,
           refers_to: str | None, date: str) -> bytes:
    """One WARC record over an HTTP response; a revisit keeps its header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    key = hashlib.md5(repr((page_id, url, digest)).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=key, version=4)}>"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest, and ``first`` (page_id, url) where another record has the payload.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one of smallest page_id
    (null last), then of smallest url (null last), is written out. Rows equal in all three are the same
    record again and are written out like it.
    """
    rows = (pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
            .withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}))
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("first_id"),
                     F.col("url").isNull().alias("b"), F.col("url").alias("first_url"))
    shared = (rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest")
              .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    itself = F.col("page_id").eqNullSafe(F.col("first.first_id")) & F.col("url").eqNullSafe(F.col("first.first_url"))
    return rows.join(shared, "digest", "left").withColumn("first", F.when(~itself, F.col("first")))


def packed(rows: DataFrame, dictionary: bytes, archive_bytes: int, date: str, level: int = 6) -> DataFrame:
    """``archive``: the records of ``marked`` rows as archives of about ``archive_bytes`` at most, one long record excepted."""
    shared = to_tasks(rows.sparkSession, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import cloudpickle
        known = cloudpickle.loads(shared.value)
        more = {"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}
        coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **more)
        head = DICTIONARY_MAGIC + len(known).to_bytes(4, "little") + known if known else b""
        frames, size = [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([head + b"".join(frames)], pa.binary())], ["archive"])

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, payload, n, digest, first = (c[i].as_py() for c in columns)
                kind = "response" if first is None else "revisit"
                refers_to = first and record_id(first["first_id"], first["first_url"], digest)
                frame = coder.compress(record(kind, page_id, url, digest, payload, n, refers_to, date))
                if frames and size + len(frame) > archive_bytes:
                    yield archive()
                    frames, size = [], 0
                frames.append(frame)
                size += len(frame)
        if frames:
            yield archive()

    return (rows.select(F.col("page_id").cast("long"), "url", "payload", "size", "digest", "first")
            .mapInArrow(run, "archive binary"))


def write(pages: DataFrame, path: str | None = None, archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z",
          dictionary: bytes | None = None) -> str:
    """Write ``pages`` (page_id, url, html; other columns are left alone) as archives, one file each; the folder's path.

    A null html is an empty payload. Line ends and spaces in a url are percent-encoded. An empty table gives no archives.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", "html")
    dictionary = learned_dictionary(pages) if dictionary is None else dictionary
    archives = packed(marked(pages), dictionary, archive_bytes, date)
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", EMPTY_FRAME).text(path)
    return path


@dataclass
class Broken(Exception):
    at: int
    reason: str


def _skippable(magic: bytes) -> bool:
    return len(magic) == 4 and magic[1:] == DICTIONARY_MAGIC[1:] and 0x50 <= magic[0] <= 0x5F


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and content of each frame of an archive; raises ``Broken`` where no further frame can be read."""
    at, known = 0, {}
    view = memoryview(data)
    if data[:4] == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        raw = data[8:at]
        if len(raw) < at - 8:
            raise Broken(0, "truncated dictionary")
        try:
            if raw[:4] == FRAME_MAGIC:
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            known = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
            coder = zstandard.ZstdDecompressor(**known)
        except zstandard.ZstdError as e:
            raise Broken(0, f"dictionary: {e}") from None
    else:
        coder = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = data[at:at + 4]
        if _skippable(magic):
            end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
            if end > len(data):
                raise Broken(at, "truncated skippable frame")
            at = end
            continue
        if magic != FRAME_MAGIC:
            raise Broken(at, "no frame")
        one, out, to = coder.decompressobj(), [], at
        try:
            while not one.eof and to < len(data):
                out.append(one.decompress(view[to:to + FEED]))
                to = min(to + FEED, len(data))
        except zstandard.ZstdError as e:
            raise Broken(at, f"frame: {e}") from None
        if not one.eof:
            raise Broken(at, "truncated frame")
        yield at, b"".join(out)
        at = to - len(one.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a line that starts with white space goes on with the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError("a header line without a name")
        out[name] = value.strip()
    return out


def parsed(raw: bytes) -> dict:
    """The record in a frame: its fields, payload and digest, and in ``error`` what does not hold."""
    out = dict.fromkeys(("record_id", "record_type", "page_id", "target_uri", "refers_to_id", "declared_digest",
                         "declared_bytes", "payload_digest", "payload", "error"))
    try:
        first, line_end, rest = raw.partition(b"\r\n")
        if first not in (b"WARC/1.0", b"WARC/1.1") or not line_end:
            raise ValueError("no WARC version line")
        head, blank, body = rest.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("header without end")
        fields = _fields(head)
        out.update(record_id=fields.get("warc-record-id"), record_type=fields.get("warc-type"),
                   target_uri=fields.get("warc-target-uri"), refers_to_id=fields.get("warc-refers-to"))
        for name in MANDATORY:
            if not fields.get(name.lower()):
                raise ValueError(f"no {name}")
        if not fields["content-length"].isdecimal():
            raise ValueError("Content-Length is no number")
        n = int(fields["content-length"])
        if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
            raise ValueError("the block is not as long as Content-Length says")
        if "page-id" in fields:
            out["page_id"] = int(fields["page-id"])
        block = body[:n]
        if not fields.get("content-type", "").startswith("application/http"):
            out.update(payload=block, payload_digest=hashlib.sha256(block).hexdigest(), declared_bytes=n)
        else:
            http, blank, payload = block.partition(b"\r\n\r\n")
            if not blank or not http.startswith(b"HTTP/"):
                raise ValueError("no HTTP header")
            inner = _fields(http.split(b"\r\n", 1)[1]) if b"\r\n" in http else {}
            if "content-length" in inner:
                out["declared_bytes"] = int(inner["content-length"])
            if out["record_type"] == "revisit":
                if payload or not out["refers_to_id"]:
                    raise ValueError("a revisit with a payload or without a record to refer to")
            else:
                out.update(payload=payload, payload_digest=hashlib.sha256(payload).hexdigest())
                if out["declared_bytes"] not in (None, len(payload)):
                    raise ValueError("the payload is not as long as the HTTP header says")
        scheme, _, declared = fields.get("warc-payload-digest", "").partition(":")
        if scheme.lower() == "sha256":
            out["declared_digest"] = declared.lower()
            if out["payload_digest"] not in (None, out["declared_digest"]):
                raise ValueError("the payload does not have the digest of its header")
    except ValueError as e:
        out["error"] = str(e)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, as ``RECORD``, checked.

    A record that does not hold has its reason in ``error``; an archive that cannot be read on has
    one last row with a null ``record_id``. Each archive is one task's row, so archives should be some
    ten to hundred megabytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kinds]

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                try:
                    for at, raw in frames(batch.column(1)[i].as_py()):
                        rows.append({"archive": name, "at": at, **parsed(raw)})
                        size += len(raw)
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                except Broken as e:
                    rows.append({**dict.fromkeys(names), "archive": name, "at": e.at, "error": e.reason})
                if rows:
                    yield batch_of(rows)

    kinds = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                       ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to_id", pa.string()),
                       ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("payload", pa.binary()), ("error", pa.string())])
    return (spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD))


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without payloads but with payload_bytes and payload_digest of the full payload, and ``refers_to``:
    the page_id of the response that a revisit refers to.

    A revisit takes both from that response; if it is not there, or is not what the revisit declares, ``error`` says so.
    """
    plain = stored(records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "records")
    responses = (plain.filter("record_type = 'response' AND error IS NULL")
                 .groupBy(F.col("record_id").alias("to_id"))
                 .agg(F.first("page_id").alias("to_page"), F.first("payload_bytes").alias("to_bytes"),
                      F.first("payload_digest").alias("to_digest")))
    revisit = F.col("record_type") == "revisit"
    # what is no revisit meets itself, so that no null key gathers it in one task
    to = F.when(revisit, F.col("refers_to_id")).otherwise(F.col("record_id"))
    found = plain.join(responses, to == F.col("to_id"), "left")
    error = (F.when(F.col("error").isNotNull() | ~revisit, F.col("error"))
             .when(F.col("to_id").isNull(), "the response is missing")
             .when((F.col("to_digest") != F.col("declared_digest")) | (F.col("to_bytes") != F.col("declared_bytes")),
                   "the response has another payload"))
    return found.select(
        "archive", "at", "record_id", "record_type", "page_id", "target_uri", F.when(revisit, F.col("to_page")).alias("refers_to"),
        F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("to_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), error.alias("error"))
