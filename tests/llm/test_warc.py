import base64
import gzip
import hashlib

import pytest

from tessera.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [(3, "http://a/x", "<p>é\r\n\r\nb"), (1, "http://a b\n", "<p>é\r\n\r\nb"), (2, None, None), (5, "u", ""), (4, "u", "WARC/1.1\r\n\r\n"), (7, "u", "y" * 50_000), (1, "again", "<p>é\r\n\r\nb")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    for least in (0, 3):
        found = sorted((tuple(r) for r in warc.archive(pages, least).collect()), key=str)
        want = []
        for p, _, h in ROWS:
            size = len((h or "").encode())
            first = min(q for q, _, x in ROWS if (x or "") == (h or ""))
            again = size >= least and first != p
            want.append((p, size, digest(h), "revisit" if again else "response", first if again else None))
        assert found == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pushdown_and_skipping(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    records = warc.read_warc(spark, f"file://{path}").where("warc_type = 'revisit'")
    assert records.count() == 2
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert reader.wanted == {"warc_type": {"revisit"}} and len(left) == 1
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}
    texts = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    assert texts.count(b"WARC-Type: response") == 5 and texts.endswith(b"\r\n\r\n")


def test_a_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"HELLO\r\n")
    for cut in (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000\r\n\r\nshort", b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\nContent-Len"):
        (tmp_path / "cut.warc").write_bytes(cut)
        for payload in (True, False):
            with pytest.raises(Exception, match="the archive ends"):
                warc.read_warc(spark, str(tmp_path / "cut.warc"), payload).collect()
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_warc(spark, str(tmp_path / "x.warc")).collect()
