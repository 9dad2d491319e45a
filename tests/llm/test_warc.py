import base64
import gzip
import hashlib

import pytest

from netloom.llm import warc


def test_arc_versions_round_trip():
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>\n\nURL 1 2 3\r\n\r\nWARC/1.1"
    for v in (1, 2):
        data = warc.arc_start(v, "a.arc", "20010203040506") + warc.arc_record(v, "http://x/a b c", "20010203040506", block, Result_code="200") + warc.arc_record(v, "http://x/", "2001", b"", mime="text/plain")
        got = list(warc.parse_arc(data))
        assert [r.url for r in got] == ["filedesc://a.arc", "http://x/a b c", "http://x/"]
        assert got[1].block == block and got[2].block == b"" and got[1].version == v
        out = list(warc.parse_warc(b"".join(warc.convert(r) + b"\r\n\r\n" for r in got)))
        kinds = [h["WARC-Type"] for h, _ in out]
        assert kinds == ["warcinfo", "response", "resource"]
        assert out[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and out[2][0]["WARC-Date"] == "2001-01-01T00:00:00Z"
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert out[1][0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert out[1][1] == block


@pytest.mark.parametrize("data", [b"no arc", b"filedesc://a 0 1 t 9\n3 0 x\nabc", warc.arc_start(1, "a", "2020") + b"http://x 0 2020 t 99\nabc", warc.arc_start(1, "a", "2020") + b"http://x 0\n"])
def test_broken_archives_are_refused(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_round_trip(spark):
    pages = [(5, "http://a/", "same", 1), (3, "http://b/\nx", "same", 1), (9, None, None, 1), (8, "u", "", 1), (7, "ü", "é\r\n\r\nWARC/1.1\r\n", 1), (7, "ü", "é\r\n\r\nWARC/1.1\r\n", 1), (11, "v", "x" * 300_000, 1), (None, "n", "same", 1), (None, "n", "alone", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, first int")
    got = sorted(map(tuple, warc.round_trip(df, archive_bytes=1000).collect()), key=repr)
    first = {}
    for p, _, h, _ in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h, _ in pages:
        body = (h or "").encode()
        again = p is not None and p != first[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    small = warc.round_trip(df, least_bytes=5).where("page_id = 5").first()
    assert small.record_type == "response" and small.refers_to is None


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_reference_resolves(spark, tmp_path):
    pages = [(3, "http://b/\nx", "same"), (3, "http://a/", "same"), (5, "http://a/", "same"), (6, None, "same"), (8, "", ""), (9, "u", None), (2, None, "twin"), (4, "v", "twin"), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    warc.write(warc.archives(df, archive_bytes=500), str(tmp_path / "out"))
    records = [h for f in (tmp_path / "out").glob("*.gz") for h, _ in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in records if h["WARC-Type"] == "response"}
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    assert all(responses.get(h["WARC-Refers-To"]) == h["WARC-Payload-Digest"] for h in revisits)
