import base64
import hashlib

from paperloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, id string, digest string")


ROWS = [(1, "http://a/\r\nX: y", "<p>é</p>\r\n\r\nx"), (2, None, "<p>é</p>\r\n\r\nx"), (3, "u", None), (4, "u", ""), (5, "v", "z" * 3_000_000), (6, "w", "only"), (None, "n", "only"), (6, "w", "only")]


def test_round_trip_and_revisits(spark):
    index = warc.write(pages(spark, ROWS))
    assert index.count() == len(ROWS)
    found = warc.read(index).collect()
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        last = max(i for i, _, h in ROWS if (h or "") == (html or "") and i is not None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = page == last
        want.append((str(page), len(body), digest, "response" if first else "revisit", None if first else last, bytes(body) if first else None))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reads_only_what_is_selected_and_spares_small_payloads(spark):
    index = warc.write(pages(spark, ROWS), least=5)
    assert {(r.page_id, r.record_type) for r in warc.read(index.where("page_id in (4, 6)")).collect()} == {(4, "response"), (6, "response")}


def test_ranges_join_neighbours():
    assert [(a, b, w) for a, b, w in warc.ranges([0, 10, 100], [10, 5, 5], gap=20)] == [(0, 15, [0, 1]), (100, 105, [2])]
    assert [w for _, _, w in warc.ranges([0, 10, 20], [10, 10, 10], gap=0, most=15)] == [[0], [1], [2]]
    assert list(warc.ranges([], [])) == []


def test_empty_table(spark):
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_records_are_as_the_standard_has_them(spark):
    import gzip
    import os
    from urllib.parse import urlparse

    index = warc.write(pages(spark, ROWS).coalesce(1), archive_bytes=1).collect()  # an archive for each record
    records = {}
    for row in index:
        with gzip.open(urlparse(row.file).path) as file:
            whole = file.read()
        about, _ = warc.parse(whole)
        assert about["WARC-Type"] == "warcinfo" and about["WARC-Filename"] == os.path.basename(urlparse(row.file).path)
        with open(urlparse(row.file).path, "rb") as file:
            file.seek(row.offset)
            fields, block = warc.parse(gzip.decompress(file.read(row.length)))
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http; msgtype=response"
        records[row.page_id] = fields
    assert len({r.file for r in index}) == len(ROWS)
    for fields in records.values():
        if fields["WARC-Type"] == "revisit":
            target = records[int(fields["X-Refers-To-Page"])]
            assert (fields["WARC-Refers-To"], fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"]) == (target["WARC-Record-ID"], target["WARC-Target-URI"], target["WARC-Date"])
