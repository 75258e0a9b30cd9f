import gzip
import hashlib
from base64 import b32encode

import pytest

from offerloom.llm import warc

ROWS = [
    (3, "http://a.org/x y", "<p>one</p>"), (1, "http://b.org/ü", "<p>one</p>"), (2, "https://c.org/", "<p>zwei ß 🙂</p>"), (4, None, None), (5, "http://d.org/", ""),
    (6, "http://e.org/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\n\nhttp://e.org/ 1 2 text/html 5\n"), (7, "http://f.org/", "x" * 300_000), (None, "http://g.org/", "<p>one</p>"),
    (8, "http://h.org/", "twice"), (8, "http://h.org/", "twice"),
]
SCHEMA = "page_id long, url string, html string, record_id string, block string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("most", [2, 3, 1000])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "records_per_file", lambda rows, size: most)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_archive(pages(spark, ROWS).repartition(2)).collect()]
    first, want, seen = {}, [], set()
    for k, _, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        again = data in seen
        seen.add(data)
        first.setdefault(data, k)
        want.append((k, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_payloads_are_never_revisits(spark):
    found = {(r.page_id, r.record_type) for r in warc.page_archive(pages(spark, ROWS[:2]), min_bytes=100).collect()}
    assert found == {(1, "response"), (3, "response")}


def test_pages_of_any_url_are_responses(spark):
    urls = ["http://a.org/", "", "example.org/x", "example.org:80/x", "ftp://a.org/f", "mailto:a@b", "HTTPS://a.org/", "filedesc://x", None]
    rows = [(i, u, "same") for i, u in enumerate(urls)] + [(None, "ftp://a.org/f", "other"), (-3, "", "below")]
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_archive(pages(spark, rows).repartition(2)).collect()}
    assert got == {(i, 4, "revisit" if i else "response", 0 if i else None) for i in range(len(urls))} | {(None, 5, "response", None), (-3, 5, "response", None)}


def test_no_rows(spark):
    assert warc.page_archive(pages(spark, [])).count() == 0


def arc(version, lines):
    about = f"{version} 0 Test\n{' '.join(warc.ARC_FIELDS[version])}\n".encode()
    head = {"1": f"filedesc://t.arc 0.0.0.0 20200101000000 text/plain {len(about)}\n", "2": f"filedesc://t.arc 0.0.0.0 20200101000000 text/plain 200 - - 0 t.arc {len(about)}\n"}[version]
    return head.encode() + about + b"\n" + b"".join(lines)


def test_both_versions_and_cut_records():
    one = arc("1", [b"http://a/ 1.2.3.4 20010203040506 text/html 5\nab\ncd\n", b"dns:a 1.2.3.4 20010203 text/dns 9\nshort"])
    rows = list(warc.parse_arc(one, "one"))
    assert [(r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows] == [
        ("http://a/", "20010203040506", "text/html", None, b"ab\ncd", False), ("dns:a", "20010203", "text/dns", None, b"short", True),
    ]
    two = arc("2", [b"http://a/ b 1.2.3.4 20010203040506 text/html 404 - - 77 t.arc 3\nabc\n"])
    assert [(r[2], r[5], r[6]) for r in warc.parse_arc(two, "two")] == [("http://a/ b", "404", b"abc")]
    assert list(warc.parse_arc(arc("1", []), "none")) == [] and list(warc.parse_arc(b"", "empty")) == []


@pytest.mark.parametrize("data", [b"http://a/ 1.2.3.4 20010203040506 text/html 5\nabcde\n", arc("1", [b"not a record line\n"]), arc("1", []).replace(b"1 0 Test", b"9 0 Test")])
def test_unreadable_files_are_named(data):
    with pytest.raises(ValueError, match="bad.arc"):
        list(warc.parse_arc(data, "bad.arc"))


def test_foreign_archives_are_converted(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\npayload\xff"
    record = b"http://a/ 1.2.3.4 199901020304 text/html %d\n" % len(http) + http + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/part-1.arc.gz").write_bytes(gzip.compress(arc("1", [record, b"dns:a 1.2.3.4 20010203040506 text/dns 3\nabc\n", record.replace(b"//a/", b"//b/")])))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    rows = sorted(warc.read_warc(spark, str(tmp_path / "warc")).collect(), key=lambda r: r.url)
    assert sorted(r.record_type for r in rows) == ["resource", "response", "revisit"]
    assert {r.url: r.date for r in rows} == {"dns:a": "2001-02-03T04:05:06Z", "http://a/": "1999-01-02T03:04:00Z", "http://b/": "1999-01-02T03:04:00Z"}
    assert {r.payload_digest for r in rows if r.url != "dns:a"} == {b32encode(hashlib.sha1(b"payload\xff").digest()).decode()}
