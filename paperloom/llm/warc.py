"""WARC archives with an index written first, and reads by coalesced byte ranges.

`write` makes archive files in each task, a new one beyond `archive_bytes` (each begins with a warcinfo
record; each record is a gzip member of its own, so it can be read alone), and returns the index: file,
offset, length, url, digest and the record's role. Records are HTTP answers; a revisit refers to its response
by record id, URI and date. `read` takes any selection of index rows, sorts each file's ranges, joins those
that touch or nearly touch and reads every joined range once.

Equal payloads are found by their digest; one row for each distinct payload is all that is shuffled
for that, after aggregation in each task, and only pages with a repeated payload are shuffled to meet it.
Archives go to the folder that the cluster shares, whole or not at all: a task that runs again writes under
another name and only its index rows count.

Defined results: null payload is empty; rows with a null id or a repeated id keep one record each
(of equal ids, any one is the response; rows of one id and payload have one record id); null url is an
empty target; payloads below `least` bytes are never revisits; very long payloads are one record each;
extra columns are ignored; empty input makes no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared, words
from paperloom.llm.exact_dedup import FILTER_BITS, _bitmap, _hit

GAP = 64 << 10
RANGE_BYTES = 8 << 20
READ_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _uri(url) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _framed(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _about(name: str) -> bytes:
    """The record that an archive begins with."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(name), "WARC-Date": DATE, "WARC-Filename": name.rsplit("/", 1)[1], "Content-Type": "application/warc-fields"}
    return _framed(head, b"software: paperloom\r\nformat: WARC File Format 1.1\r\n")


def _record(page, url, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    """One WARC/1.1 record of an HTTP answer; a revisit has the answer's head alone, which says how long the payload is."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(f"{page} {digest}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": "" if page is None else str(page),
    }
    if refers_to is not None:
        head |= {
            "WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(f"{refers_to} {digest}"),
            "WARC-Refers-To-Target-URI": _uri(refers_url), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": str(refers_to),
        }
    head["Content-Type"] = "application/http; msgtype=response"
    return _framed(head, answer if refers_to is not None else answer + payload)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def roles(rows: DataFrame, least: int) -> DataFrame:
    """Per repeated payload of (id, url, payload, sha1): its hash and the id and url of its response."""
    return (
        rows.where(F.octet_length("payload") >= least).groupBy("sha1")
        .agg(F.max(F.struct("id", "url")).alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.unhex("sha1").alias("found_sha1"), F.col("response.id").alias("response"), F.col("response.url").alias("response_url"))
    )


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archive every row of pages; the index, one row for each record."""
    spark = pages.sparkSession
    target = shared.folder(spark, "warc")

    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    repeats = shared.written(roles(rows, least), "warc-roles")
    # Only pages whose payload may be a repeated one are shuffled. Another form of the key than the
    # aggregation's, so that adaptive execution may split a large group.
    key = F.xxhash64(F.unhex("sha1"))
    may = _hit(_bitmap(repeats, F.xxhash64("found_sha1"), FILTER_BITS), key, FILTER_BITS)
    kept = "id", "url", "payload", "response", "response_url"
    judged = rows.where(may).join(repeats, F.unhex("sha1") == F.col("found_sha1"), "left").select(*kept).unionByName(
        rows.where(~may).select("id", "url", "payload", F.lit(None).cast("long").alias("response"), F.lit(None).cast("string").alias("response_url"))
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = sink = None
        at, index = 0, []
        for batch in batches:
            for block in words.blocks(batch, "payload"):
                for page, url, text, response, response_url in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if sink is None:
                        name = f"{target}/{uuid.uuid4().hex}.warc.gz"
                        sink, about = shared.stream(name + ".part"), gzip.compress(_about(name), 1, mtime=0)
                        sink.write(about)
                        at = len(about)
                    payload = text.encode()
                    refers_to = response if response is not None and response != page else None
                    digest = _digest(payload)
                    packed = gzip.compress(_record(page, url, payload, digest, refers_to, response_url), 1, mtime=0)
                    sink.write(packed)
                    index.append((name, at, len(packed), page, url, digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(packed)
                    if at >= archive_bytes:
                        sink.close()
                        shared.finish(name + ".part", name)
                        sink = None
            if len(index) >= 50_000:
                yield from _rows(index)
                index = []
        if sink is not None:
            sink.close()
            shared.finish(name + ".part", name)
        for n in range(0, len(index), 50_000):
            yield from _rows(index[n : n + 50_000])

    return shared.written(judged.mapInArrow(archive, INDEX), "warc-index")


def _rows(index: list[tuple]) -> Iterator[pa.RecordBatch]:
    if index:
        names = ["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = RANGE_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """Joined byte ranges (start, end, which) of ranges sorted by offset."""
    start = end = 0
    which: list[int] = []
    for n, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
        if which and (offset > end + gap or offset + length - start > most):
            yield start, end, which
            which = []
        start = offset if not which else start
        end = max(end, offset + length) if which else offset + length
        which.append(n)
    if which:
        yield start, end, which


def read(index: DataFrame, payloads: bool = True, gap: int = GAP) -> DataFrame:
    """The records that the index rows name, one row each; payload is null for revisits."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                stop = at
                while stop < len(files) and files[stop] == files[at]:
                    stop += 1
                if files[at] != name:
                    if file is not None:
                        file.close()
                    name, file = files[at], shared.opened(files[at])
                for start, end, which in ranges(offsets[at:stop], lengths[at:stop], gap):
                    file.seek(start)
                    data = file.read(end - start)
                    out = []
                    for n in which:
                        first = offsets[at + n] - start
                        fields, block = parse(zlib.decompress(data[first : first + lengths[at + n]], 31))
                        out.append(_checked(fields, block, payloads))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                at = stop
        if file is not None:
            file.close()

    # A task for each READ_BYTES of what is asked for: an archive's stretches are read by as many tasks as it has of them.
    narrow = index.select("file", "offset", "length", F.expr(f"offset div {READ_BYTES}").alias("stretch"))
    total = narrow.agg(F.sum("length")).first()[0] or 0
    dealt = narrow.repartition(max(1, -(-total // READ_BYTES)), "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.drop("stretch").mapInArrow(fetch, READ)


def _checked(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    answer, _, payload = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in answer.decode().split("\r\n")[1:])
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(said["Content-Length"])
    page = int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None
    if fields["WARC-Type"] == "revisit":
        return page, fields["WARC-Target-URI"], size, digest, "revisit", int(fields["X-Refers-To-Page"]), None
    if len(payload) != size or _digest(payload) != digest:
        raise ValueError(f"record of page {page} is damaged: {len(payload)} bytes, digest {_digest(payload)}, not {size}, {digest}")
    return page, fields["WARC-Target-URI"], size, digest, "response", None, payload if payloads else None
