import gzip
import hashlib
import io
import json

import corpus
import pytest

from tenderflow.llm import warc

PAGES = "page_id long, url string, html string, path string, digest string, records long"


def rows():
    same, long = "x" * 100, "é<p>" * 700_000
    out = [(1, "http://a/", same), (2, "http://b/\r\n é", same), (3, None, same), (4, "", "x" * 99),
           (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long),
           (10, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 9), (11, "u", "\r\n\r\n"),
           (None, "u", "y" * 100), (None, "u", "y" * 100), (12, "u", "z" * 100), (12, "u", "z" * 100),
           (None, "u", "z" * 100)]
    out += [(100 + i, "u", f"page {i % 150} " * 20) for i in range(200)]
    return [(*row, "p", "d", 1) for row in out]


def expected():
    firsts = {}
    for page_id, _, html, *_ in rows():
        if page_id is not None and len((html or "").encode()) >= 100:
            firsts[html] = min(page_id, firsts.get(html, page_id))
    out = []
    for page_id, _, html, *_ in rows():
        data = (html or "").encode()
        first = firsts.get(html)
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("most", [warc.ARCHIVE_BYTES, 5000])
def test_round_trip(spark, most):
    pages = spark.createDataFrame(rows(), PAGES).repartition(3)
    streams = warc.write_archives(pages, most)
    files = warc.normalise_archives(streams)
    found = warc.read_archives(files)
    assert corpus.rows_of(found.select(*COLUMNS)) == expected()
    payloads = {r.page_id: r.payload for r in found.collect() if r.record_type == "response"}
    for page_id, _, html, *_ in rows():
        if payloads.get(page_id) is not None and page_id is not None:
            assert payloads[page_id] == (html or "").encode()
    if most == 5000:
        assert streams.count() > 20
    # each file was one gzip member, and now each line of the sidecar is one
    for row in files.collect():
        store, at = warc.open_store(row.path)
        data = store.open_input_file(at).read()
        lines = warc.open_store(row.sidecar)[0].open_input_file(
            warc.open_store(row.sidecar)[1]).read().splitlines()
        assert len(lines) == row.records
        entries = [json.loads(line) for line in lines]
        assert sum(e["length"] for e in entries) == len(data)
        for e in entries:
            record = gzip.decompress(data[e["offset"]:e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and e["id"].encode() in record


def test_inflates_any_members_and_says_what_is_broken():
    record = warc.header({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Length": "3"})
    record += b"abc\r\n\r\n"
    for packed in (gzip.compress(record * 3), gzip.compress(record) * 3,
                   gzip.compress(record[:20]) + gzip.compress(record[20:] + record * 2)):
        sink, sidecar = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(packed), sink, sidecar) == 3
        assert gzip.decompress(sink.getvalue()) == record * 3
    for broken in (record[:-4], record[:-5], record[:10], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(gzip.compress(broken)), io.BytesIO(), io.BytesIO())


def test_no_rows(spark):
    assert warc.round_trip(corpus.empty(spark, PAGES)).count() == 0
