"""The WARC archive: exact round trips, verified payloads, revisits."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import warc

PAGES = "page_id long, url string, html string"


def archived(pages, folder, least=0):
    return warc.store_pages(pages, f"file://{folder}/archive", least)


def answer(rows, least=0):
    first = {}
    for i, (page, url, html) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] is None, x[1][1] or "")):
        first.setdefault(html or "", i)
    out = []
    for i, (page, url, html) in enumerate(rows):
        raw = (html or "").encode()
        other = len(raw) >= least and first[html or ""] != i
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", rows[first[html or ""]][0] if other else None))
    return sorted(out, key=str)


def found(archive):
    rows = warc.resolve_revisits(warc.parse(warc.restore(archive))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted((tuple(r) for r in rows), key=str)


def odd_pages():
    rng = random.Random(3)
    long = "".join(rng.choice("abcé𝒳<>\r\n") for _ in range(200_000))
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/\r\nWARC-Type: fake", None), (2, "", ""), (None, "http://d/", "same"), (7, "http://e/", long), (8, "http://f/", long)]
    rows += [(11, "http://g/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"), (12, "http://g/", "\x00\r\n\r\n"), (None, None, None), (13, "http://h/", "twin"), (14, "http://h/", "twin")]
    return rows


@pytest.mark.parametrize("least", [0, 4, 5])
def test_pages(spark, tmp_path, least):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "at": F.lit("x"), "size": F.lit(2), "record_id": F.lit("y"), "payload": F.lit(3)})
    archive = archived(pages.repartition(3, "url"), tmp_path, least)
    assert found(archive) == answer(rows, least)
    assert archive.payloads.count() == len({html or "" for _, _, html in rows})


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "t")] * 4 + [(2, "u", "t")]
    kinds = [r[3:] for r in found(archived(spark.createDataFrame(rows, PAGES), tmp_path))]
    assert sorted(kinds, key=str) == [("response", None)] + [("revisit", 1)] * 4


def test_no_pages(spark, tmp_path):
    assert found(archived(spark.createDataFrame([], PAGES), tmp_path)) == []


def test_files_and_back(spark, tmp_path):
    archive = archived(spark.createDataFrame(odd_pages(), PAGES), tmp_path)
    before = warc.restore(archive)
    warc.write_files(before, f"file://{tmp_path}/files", most_records=4)
    files = sorted((tmp_path / "files").glob("part-*"))
    assert len(files) >= 4
    again = warc.store_records(warc.read_files(spark, f"file://{tmp_path}/files/part-*"), f"file://{tmp_path}/second")
    exact = {r.file: b"" for r in again.headers.select("file").distinct().collect()}
    for r in warc.record_bytes(warc.restore(again)).orderBy("file", "at").collect():
        exact[r.file] += r.record
    assert {k.rsplit("/", 1)[1]: v for k, v in exact.items()} == {f.name: f.read_bytes() for f in files}
    inside = sorted(bytes(r.record) for r in warc.record_bytes(before).collect())
    assert inside == sorted(bytes(r.record) for r in warc.record_bytes(warc.restore(again)).collect())


def test_gzipped_and_other_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n"
    asked = b"WARC/1.0\r\nwarc-type:request\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(asked))
    (tmp_path / "b.warc").write_bytes(info + asked + info)
    rows = warc.read_files(spark, f"file://{tmp_path}/*.warc*")
    archive = warc.store_records(rows, f"file://{tmp_path}/archive")
    assert archive.payloads.count() == 2
    got = {}
    for r in warc.record_bytes(warc.restore(archive)).orderBy("file", "at").collect():
        got[r.file[-6:]] = got.get(r.file[-6:], b"") + r.record
    assert got == {"arc.gz": info + asked, "b.warc": info + asked + info}
    assert [t for t in sorted(r.record_type for r in warc.parse(warc.restore(archive)).collect())] == ["request"] * 2 + ["warcinfo"] * 3


def test_damage_is_an_error(spark, tmp_path):
    archive = archived(spark.createDataFrame([(1, "u", "right"), (2, "v", "other")], PAGES), tmp_path)
    body = F.when(F.col("size") == 5, F.lit(__import__("zstandard").compress(b"wrong"))).otherwise(F.col("body"))
    with pytest.raises(Exception, match="is damaged"):
        warc.restore(archive._replace(payloads=archive.payloads.withColumn("body", body))).collect()
    with pytest.raises(Exception, match="no payload"):
        warc.restore(archive._replace(payloads=archive.payloads.limit(1))).collect()
    for broken in (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", b"no record at all", b"WARC/1.0\r\nX: y\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.split_records(broken))


def test_base32(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(50)], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in rows)
