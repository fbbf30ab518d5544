import base64
import gzip
import hashlib
from pathlib import Path
from urllib.parse import urlparse

import pytest

from lontar.llm import shared, warc

PAGES = "page_id long, url string, html string, offset string, archive int"
ROWS = [
    (1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/3", "same"), (2, "http://a/2", "é only"), (7, None, None), (8, "http://a/8", ""), (9, "x\r\ny", "x" * 300_000),
    (None, "http://n", "same"), (None, "http://n", "twice null"), (None, "http://n", "twice null"), (11, "http://r", "rep"), (11, "http://r", "rep"), (10, "http://r", "rep"),
]


def want(rows, least=0):
    out = []
    for p, _, h in rows:
        h = h or ""
        same = [q for q, _, g in rows if (g or "") == h and q is not None]
        top = max(same, default=None) if len(h.encode()) >= least else None
        refers = None if top is None or p == top else top
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((p, len(h.encode()), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, archive_bytes, limit", [(0, 1 << 28, 200_000), (4, 600, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, least, archive_bytes, limit):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
    folder = (tmp_path / "w").as_uri()
    pages = spark.createDataFrame([(*x, "clash", 1) for x in ROWS], PAGES).repartition(3)
    index = warc.write_archives(pages, folder, least_bytes=least, archive_bytes=archive_bytes)
    got = warc.read_records(index, folder).collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=repr) == want(ROWS, least)
    html = {p: h or "" for p, _, h in ROWS}
    for x in got:
        assert x.payload is None if x.record_type == "revisit" else x.page_id is None or x.payload.decode() == html[x.page_id]
    assert {x.url for x in got if x.page_id == 9} == {"x%0D%0Ay"}
    some = warc.read_records(index.filter("page_id = 2"), folder).collect()
    assert [x.payload.decode() for x in some] == ["é only"]
    for row in index.collect():  # each record is a gzip member of its own, at the place that the index names
        raw = Path(urlparse(folder).path, row.archive).read_bytes()[row.offset : row.offset + row.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: " + row.record_type.encode())


def test_damage_is_seen():
    raw = warc.record(1, "u", b"payload", warc.base32_digest(b"payload"), None)
    assert warc.parse(raw)[0] == 1
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload\r", b"Payload\r"))
    with pytest.raises(ValueError, match="WARC record"):
        warc.parse(raw[:-2])


def test_no_pages(spark, tmp_path):
    folder = (tmp_path / "none").as_uri()
    index = warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert index.count() == 0 and warc.read_records(index, folder).collect() == []
