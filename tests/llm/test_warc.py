"""WARC round trips, splits of every size, damaged files."""

import gzip
import random

import pytest

from sparkveil.llm import warc

from ..conftest import SF


def key(r):
    return tuple((x is None, x) for x in r)


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    assert sorted(map(tuple, warc.round_trip(pages, 7000).collect())) == sorted(map(tuple, pages.collect()))


@pytest.mark.parametrize("split", [1, 17, 200, 5000, 1 << 30])
def test_each_record_has_one_owner(tmp_path, split):
    r = random.Random(split)
    bodies = [bytes(r.randrange(256) for _ in range(r.randint(0, 300))) + b"\x1f\x8b\x08" * r.randint(0, 3) for _ in range(20)]
    data, starts = b"", []
    for i, b in enumerate(bodies):
        starts.append(len(data))
        head = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(b)
        data += warc.gzip_member(head + b + b"\r\n\r\n", i % 10)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with path.open("rb") as f:
        found = [(at, block) for s in range(0, len(data), split) for at, _, block in warc.members(f, s, min(len(data), s + split))]
    assert found == list(zip(starts, bodies))


def test_damage_costs_one_record(spark, tmp_path):
    parts = [warc.gzip_member(warc.record(i, f"http://h/{i}", "<p>" + "text " * 50 + f"{i}</p>")) for i in range(6)]
    parts[2] = parts[2][:40] + bytes(8) + parts[2][48:]
    parts[5] = parts[5][:-30]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc.gz").write_bytes(b"".join(parts[:4]) + b"noise \x1f\x8b\x08\x00 noise" + gzip.compress(b"no record") + b"".join(parts[4:]))
    (tmp_path / "d" / "empty.warc.gz").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path / "d"), 100).collect()
    assert sorted(r["url"] for r in rows) == [f"http://h/{i}" for i in (0, 1, 3, 4)]


def test_defined_cases(spark):
    long = "<p>" + "long page " * 200000 + "</p>"
    rows = [(1, "http://a/", "<p>a</p>", "x"), (2, None, "b", "x"), (3, "http://c/", None, "x"), (4, "http://d/", "", "x"), (None, "http://e/", "e", "x"), (1, "http://a/", "<p>a</p>", "x"), (-7, "http://f/\r\nX: %0A", "\r\n\r\n", "x"), (8, "http://g/", long, "x"), (9, "", "é€\U0001f600\x1f", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    out = warc.round_trip(pages, 1000)
    assert out.columns == ["page_id", "url", "html"]
    assert sorted(map(key, out.collect())) == sorted(key(r[:3]) for r in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_urls_of_any_length_and_outer_white_space(spark):
    urls = ["data:text/html," + "a%20" * 250_000, "  http://a/ ", "\thttp://b/%41\u00a0", " \u2003 ", "\n", "http://c/ \u00e9%\r", "%0A", "x%", "\x1f\u00e9"]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(pages, 1000).collect())) == rows


def test_bytes_that_are_no_utf8_come_back(spark):
    rows = [(1, bytearray(b"http://a/\xff"), bytearray(b"<p>\xc3\x28\xff</p>")), (2, bytearray(b" \xfe\n"), bytearray(b"\xed\xa0\x80"))]
    pages = spark.createDataFrame(rows, "page_id long, url binary, html binary").selectExpr("page_id", "cast(url as string) url", "cast(html as string) html")
    out = warc.round_trip(pages, 1000).selectExpr("page_id", "cast(url as binary) url", "cast(html as binary) html")
    assert sorted(map(tuple, out.collect())) == rows
