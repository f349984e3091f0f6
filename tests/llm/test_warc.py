import gzip
import hashlib

import pytest

from speechlake.llm.warc import Malformed, archive_round_trip, digest, read_records, write_record


def test_records_stand_alone_and_are_framed():
    pages = [(1, "http://a/b c\r\nX: y", b"<p>\r\n\r\nWARC/1.1\r\n</p>" * 9, None), (2, None, b"", None), (None, "u", b"x" * 300_000, None), (4, "http://a", b"x" * 300_000, 3)]
    members = [write_record(*p) for p in pages]
    archive = b"".join(members)
    assert gzip.decompress(members[0]).startswith(b"WARC/1.1\r\n")
    got = list(read_records(archive))
    assert [r.kind for r in got] == ["response", "response", "response", "revisit"]
    assert [r.http()[1] for r in got] == [pages[0][2], b"", pages[2][2], b""]
    assert [(r.offset, r.length) for r in got] == [(sum(map(len, members[:i])), len(m)) for i, m in enumerate(members)]
    assert got[3].fields["warc-refers-to"] == "<urn:page:3>" and got[3].fields["warc-payload-digest"] == digest(pages[3][2])


def test_damage_is_found():
    record = write_record(1, "u", b"payload" * 50, None)
    with pytest.raises(Malformed):
        list(read_records(record[:-20]))
    raw = gzip.decompress(record)
    for bad in (raw.replace(b"payload", b"Payload", 1), raw.replace(b"Content-Length: ", b"Content-Length: 1"), raw[:-2], b"HTTP" + raw, raw.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(Malformed):
            list(read_records(gzip.compress(bad)))


def test_round_trip(spark):
    big, other = "é<p>" * 300, "z" * 1000
    rows = [(1, "u", big), (5, "v", big), (3, None, big), (2, "w", other), (9, "x", "small"), (8, "x", "small"), (6, "x", None), (7, "", ""), (5, "v", big), (None, "n", other), (None, "n", "y" * 2000), (10, "long", "q" * 9_000_000)]
    got = archive_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        holder = max((j for j, _, h in rows if h == html and j is not None), default=None)
        to = holder if len(raw) >= 1000 and holder != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
