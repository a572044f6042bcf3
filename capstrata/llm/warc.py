"""WARC archives, index first: each partition writes one archive and an index row for each record, and reads of selected
records are sorted by place and coalesced into few byte ranges.

Archives are gzip members, one for each record. They lie in the folder that the session's executors share and are
reached by its URI, so the folder may be in any store that pyarrow's file systems know. The name of an archive holds
the task attempt: the index is the only way to a record, and it lists the archives of the attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import cut, read_table, shared_folder

#: Equal payloads from this size on are stored once.
REVISIT_FROM = 100
#: Ranges closer than the gap are read as one, up to so many bytes at once.
GAP, READ_BYTES = 1 << 16, 1 << 23
#: Bytes of archives that one reading task takes on.
SPLIT_BYTES = 1 << 23
#: Shared payloads are broadcast up to so many (about 100 bytes each); more are joined by shuffling.
BROADCAST_DIGESTS = 250_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def with_digests(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with the SHA-256 of the payload, in hexadecimal."""
    return pages.select("page_id", "url", "html", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest"))


def shared_payloads(digested: DataFrame) -> DataFrame:
    """(digest, refers_to) of the payloads of several page_ids that are large enough; refers_to is the smallest of those.

    Only digests are shuffled. They are counted before the shuffle, so a payload that a third of all pages share is
    one row of each task.
    """
    named = digested.where((F.octet_length(F.coalesce(F.col("html"), F.lit("")).cast("binary")) >= REVISIT_FROM) & F.col("page_id").isNotNull())
    ends = named.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    return cut(ends.where("last > refers_to").select("digest", "refers_to"))


def _header(value: str | None) -> str:
    """A header's value on one line; percent signs and line breaks are percent-encoded."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload_bytes: int, body: bytes) -> bytes:
    """One record as a gzip member: HTTP headers and, of a response, the payload.

    A record is named by its page and payload. A revisit has no payload; its length is a header of its own.
    """
    name = lambda page: f"<urn:page:{'' if page is None else page}:{digest}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + len(body)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse(member: bytes) -> dict:
    """The record of a gzip member: what the index says of it, and its payload. A damaged one raises."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(named["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    page, _, digest = named["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">").partition(":")
    refers, _, of = named.get("WARC-Refers-To", f"<urn:page::{digest}>").removeprefix("<urn:page:").rstrip(">").partition(":")
    if named["WARC-Payload-Digest"] != f"sha256:{digest}" or of != digest:
        raise ValueError("a record's digest differs from that of its name or of what it refers to")
    return {
        "page_id": int(page) if page else None,
        "url": named["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": named["WARC-Type"],
        "refers_to": int(refers) if refers else None,
        "payload_digest": digest,
        "payload_bytes": int(named["X-Payload-Length"]),
        "body": rest[:size].partition(b"\r\n\r\n")[2],
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; null html: empty) and returns the index, materialised.

    The index has page_id, url, record_type, refers_to, payload_digest, payload_bytes, archive, offset, length.
    Rows are told apart by page_id and payload: of equal payloads the smallest page_id is the response (all its rows,
    where it has several), and a page_id with several payloads has a record of each. A page without page_id is always
    a response. Payloads are not shuffled, unless more than BROADCAST_DIGESTS of them are shared.
    """
    digested = with_digests(pages)
    shared = shared_payloads(digested)
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    placed = digested.join(shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("refers_to"), F.col("refers_to")).alias("refers_to"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        offset, out = 0, None
        try:
            for batch in it:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    body = (html or "").encode("utf-8", "surrogatepass")
                    kind = "response" if refers_to is None else "revisit"
                    member = record(page_id, url, kind, refers_to, digest, len(body), b"" if refers_to is not None else body)
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append({"page_id": page_id, "url": url, "record_type": kind, "refers_to": refers_to, "payload_digest": digest, "payload_bytes": len(body), "archive": name, "offset": offset, "length": len(member)})
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return cut(placed.mapInArrow(batches, _INDEX))


def payload_places(index: DataFrame) -> DataFrame:
    """(page_id, payload_digest, archive, offset, length): where the payload of each row of an index lies; of a revisit that is its response's record."""
    own = index.where("record_type = 'response'").select("page_id", "payload_digest", "archive", "offset", "length")
    held = own.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min(F.struct("archive", "offset", "length")).alias("at"))
    others = index.where("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to")
    return own.unionByName(others.join(held, ["refers_to", "payload_digest"]).select("page_id", "payload_digest", "at.*"))


def ranges(places: Iterator[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Coalesced reads of (offset, length) sorted by offset: (offset, end, first, last + 1) with places of the records."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(places):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, end, first, _ = out[-1]
            out[-1] = (start, max(end, offset + length), first, i + 1)
        else:
            out.append((offset, offset + length, i, i + 1))
    return out


def read_archives(index: DataFrame, folder: str, with_body: bool = False) -> DataFrame:
    """The records of selected index rows, read from the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes (and body).

    Index rows of one stretch of an archive meet in one task, sorted by offset. The digest and size of each response
    are computed again from its body; a record that differs from what the index or its headers say fails the job.
    """
    stretch = F.floor(F.col("offset") / SPLIT_BYTES)
    ordered = index.select("archive", "offset", "length", "payload_digest", stretch.alias("stretch")).repartition("archive", "stretch").sortWithinPartitions("archive", "offset")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in it:
            archives, offsets, lengths, digests = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(archives):
                stop = at
                while stop < len(archives) and archives[stop] == archives[at]:
                    stop += 1
                with store.open_input_file(f"{base}/{archives[at]}") as source:
                    for start, end, first, last in ranges(zip(offsets[at:stop], lengths[at:stop], strict=True)):
                        block = source.read_at(end - start, start)
                        rows = []
                        for i in range(at + first, at + last):
                            row = parse(block[offsets[i] - start : offsets[i] - start + lengths[i]])
                            if row["record_type"] == "response" and (hashlib.sha256(row["body"]).hexdigest(), len(row["body"])) != (row["payload_digest"], row["payload_bytes"]):
                                raise ValueError(f"payload of {row['page_id']} differs from its digest")
                            if row["payload_digest"] != digests[i]:
                                raise ValueError(f"record at {archives[i]}:{offsets[i]} is not the one in the index")
                            rows.append(row)
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                at = stop

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    schema = pa.schema([*fields, ("body", pa.binary())] if with_body else fields)
    text = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + (", body binary" if with_body else "")
    return ordered.mapInArrow(batches, text)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to a new folder and read back by their index. A null html is empty; repeated rows
    have a record each, also those of one page_id with several payloads; no rows, no records.
    """
    pages = read_table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    index = write_archives(pages, folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from f
"""
