from __future__ import annotations

import hashlib
import io

import pytest

from tracewright.llm import warc as w
from tracewright.llm.common import scratch

LONG = "<p>é" * 60
PAGES = [(5, "http://a/x y", LONG), (3, "http://b/", LONG), (9, None, LONG), (4, "u", "short"), (2, "u", "short"), (1, "z", None), (None, "n", LONG), (7, "http://c/\n", "x" * 300000), (3, "http://b/", LONG), (8, "q", "HTTP/1.1 200 OK\r\n\r\n" + "y" * 200)]


def test_arc_headers_of_both_versions():
    for version in (1, 2):
        data = w.arc_version_block("f.arc", version, "19990101000000") + w.arc_record(b"http://a/%20 b", "1.2.3.4", "199901010000", b"text/html", b"one\ntwo", version) + w.arc_record(b"u", "-", "19990101", b"x", b"", version)
        got = list(w.read_arc(io.BytesIO(data)))
        assert [b for _, b in got] == [b"one\ntwo", b""] and got[0][0][b"URL"] == b"http://a/%20 b" and got[1][0][b"Archive-date"] == b"19990101"
        with pytest.raises(ValueError):
            list(w.read_arc(io.BytesIO(data[:-9] if version == 1 else data[: data.index(b"two")])))
    assert [w.warc_date(d) for d in ("20080430204825", "200804302048", "20080430")] == ["2008-04-30T20:48:25Z", "2008-04-30T20:48:00Z", "2008-04-30T00:00:00Z"]


def test_records_round_trip():
    blocks = [b"", b"\r\n\r\n", b"WARC/1.1\r\n" * 3, bytes(range(256)) * 3000]
    data = b"".join(w.warc_record([("WARC-Type", "resource"), ("X", str(i))], b) for i, b in enumerate(blocks))
    got = list(w.read_warc(io.BytesIO(data)))
    assert [b for _, b in got] == blocks and [f["x"] for f, _ in got] == list("0123")
    assert all(f["warc-block-digest"] == w.sha256(b) for f, b in got)


@pytest.mark.parametrize("parts", [1, 3])
def test_pages_through_archives(spark, parts):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(parts)
    arcs = w.write_arc(pages, scratch(spark, "arc"), "20080430204825", arc_bytes=3000)
    assert {r.version for r in arcs.collect()} == {1, 2}
    warcs = w.convert(arcs, scratch(spark, "warc"))
    assert sum(r.records for r in warcs.collect()) == len(PAGES)
    out = w.scan_warc(warcs).collect()
    payload = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert len(out) == len(PAGES)
    for r in out:
        assert r.payload_bytes == len(payload[r.page_id]) and r.payload_digest == hashlib.sha256(payload[r.page_id]).hexdigest()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=str)
    assert kinds == sorted([(5, "revisit", 3), (3, "response", None), (3, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (4, "response", None), (2, "response", None), (1, "response", None), (7, "response", None), (8, "response", None)], key=str)


def test_empty(spark):
    assert w.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_headers_of_old_files(spark, tmp_path):
    """Blanks in a URL, CRLF line ends, empty lines between records, short dates, no address, a block that isn't HTTP, gzip members, and a record cut short."""
    plain = (
        b"filedesc://old.arc 0.0.0.0 19961022 text/plain 77\r\n1 0 Some Archive\r\nURL IP-address Archive-date Content-type Archive-length\r\n"
        b"\r\nhttp://a/b c d.html 10.0.0.1 19961022112233 text/html 27\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nhi"
        b"\n\n\ngopher://x/ - 199610 text/plain 5\r\nhello"
    )
    plain = plain.replace(b"text/plain 77", b"text/plain %d" % len(b"1 0 Some Archive\r\nURL IP-address Archive-date Content-type Archive-length\r\n"))
    got = list(w.read_arc(io.BytesIO(plain)))
    assert [(f[b"URL"], f[b"Archive-date"], b[-5:]) for f, b in got] == [(b"http://a/b c d.html", b"19961022112233", b"\n\r\nhi"), (b"gopher://x/", b"199610", b"hello")]
    files = {"plain.arc": plain, "packed.arc.gz": w.member(w.arc_version_block("p", 2, "20010203")) + w.member(w.arc_record(b"u", "1.1.1.1", "20010203", b"text/html", w.http_block(1, b"z" * 200), 2)), "cut.arc": plain[:-2], "empty.arc": b"", "nonsense.arc": b"\n\n\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{n}", 1, 1) for n in files], w.ARC_MANIFEST)
    done = {r.path.rsplit("/", 1)[-1].split(".")[0]: (r.records, r.malformed) for r in w.convert(manifest, scratch(spark, "warc")).collect()}
    assert done.pop("nonsense", (0, 0))[0] == 0
    assert done == {"plain": (2, 0), "packed": (1, 0), "cut": (1, 1)}


def records(warcs):
    out = []
    for r in warcs.collect():
        fs, inner = w.opened(r.path)
        with fs.open_input_stream(inner) as f:
            out += [fields for fields, _ in w.read_warc(f)]
    return out


def test_two_runs_give_the_same_identifiers(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2, "url")
    runs = [records(w.convert(w.write_arc(pages, scratch(spark, "arc"), "20080430204825", arc_bytes=3000), scratch(spark, "warc"))) for _ in range(2)]
    key = lambda f: (f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"))
    assert sorted(map(key, runs[0]), key=str) == sorted(map(key, runs[1]), key=str)
    ids = {f["warc-record-id"]: f for f in runs[0]}
    assert len(ids) == len(runs[0])
    for f in runs[0]:
        if f["warc-type"] == "revisit":
            to = ids[f["warc-refers-to"]]
            assert (f["warc-refers-to-target-uri"], f["warc-refers-to-date"]) == (to["warc-target-uri"], to["warc-date"]) and to["warc-type"] == "response"
