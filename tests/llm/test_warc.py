"""WARC archives: round trip, framing, breaks."""

import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from proofcast.llm import warc

BIG = "<p>" + "x" * 200
PAGES = [
    (3, "http://a/3", BIG), (1, "http://a/1", BIG), (2, None, BIG), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a 6", None), (7, "u", ""),
    (8, "u", "é" * 50), (9, "u", "é" * 50), (10, "u", "é" * 49 + "x"), (None, "u", BIG), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20000), (12, "u", "y" * 300), (12, "u", "y" * 300),
]


def read(spark, rows):
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id bigint, url string, html string, payload string, first int").repartition(3)
    return warc.archive(pages).collect()


def test_round_trip(spark):
    got = {r["record_id"]: r for r in read(spark, PAGES[:13])}
    assert len(got) == 13
    for page_id, url, html in PAGES[:13]:
        row, payload = got[f"urn:page:{'null' if page_id is None else page_id}"], (html or "").encode()
        assert (row["payload_bytes"], row["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        refers = {2: 1, 3: 1, 9: 8}.get(page_id)
        assert (row["record_type"], row["refers_to"]) == (("revisit", f"urn:page:{refers}") if refers else ("response", None))
        assert row["payload"] is None if refers else bytes(row["payload"]) == payload
        assert row["target_uri"] == ("".join(url.split()) if url else None)


def test_repeated_and_no_pages(spark):
    assert [r["record_type"] for r in read(spark, PAGES[12:])] == ["response", "response"]
    assert read(spark, []) == []


def archive_bytes():
    return [warc.record("urn:page:1", "response", None, "u", 5, hashlib.sha256(b"hello").hexdigest(), b"hello"), warc.record("urn:page:2", "revisit", "urn:page:1", "u", 5, hashlib.sha256(b"hello").hexdigest(), b"")]


class Drip(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_each_record_is_a_member_of_its_own():
    parts = archive_bytes()
    assert all(gzip.decompress(p).startswith(b"WARC/1.1\r\n") for p in parts)
    rows = list(warc.records(Drip(b"".join(parts))))
    assert [r[:3] for r in rows] == [("urn:page:1", "response", None), ("urn:page:2", "revisit", "urn:page:1")]
    assert rows[0][6] == b"hello" and rows[1][4] == 5


@pytest.mark.parametrize(
    "broken",
    [
        lambda plain: plain.replace(b"hello\r\n\r\n", b"hellx\r\n\r\n"),
        lambda plain: plain.replace(b"WARC/1.1", b"WARD/1.1"),
        lambda plain: plain[:-6],
        lambda plain: plain + b"x",
        lambda plain: plain[:40],
    ],
)
def test_breaks_are_found(broken):
    plain = gzip.decompress(archive_bytes()[0])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(pack.compress(broken(plain)) + pack.flush())))


def test_a_cut_file_is_found():
    whole = b"".join(archive_bytes())
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(whole[:-9])))


def test_files_without_a_commit_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "archive")
    rows = spark.createDataFrame([("urn:page:1", "response", None, "u", 1, hashlib.sha256(b"a").hexdigest(), bytearray(b"a"))], warc.SCHEMA)
    warc.write_warc(rows, f"file://{folder}")
    with open(os.path.join(folder, "part-lost.warc.gz"), "wb") as lost:
        lost.write(b"half a reco")
    assert warc.read_warc(spark, f"file://{folder}").count() == 1


def row(n):
    return (f"urn:page:{n}", "response", None, "u", 1, hashlib.sha256(b"a").hexdigest(), bytearray(b"a"))


def ids(spark, uri):
    return sorted(r["record_id"] for r in warc.read_warc(spark, uri).collect())


def test_commits_add_up_and_overwriting_replaces(spark, tmp_path):
    uri = f"file://{tmp_path}/archive"
    frame = lambda *n: spark.createDataFrame([row(k) for k in n], warc.SCHEMA)
    warc.write_warc(frame(1, 2), uri)
    warc.write_warc(frame(3), uri)
    assert ids(spark, uri) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    warc.write_warc(frame(4), uri, mode="overwrite")
    assert ids(spark, uri) == ["urn:page:4"]
    assert sum(n.endswith(".warc.gz") for n in os.listdir(tmp_path / "archive")) == 1


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    uri = f"file://{tmp_path}/archive"
    warc.write_warc(spark.createDataFrame([row(1)], warc.SCHEMA), uri)
    bad = spark.createDataFrame([row(k) for k in range(40)], warc.SCHEMA).repartition(4)
    broken = bad.withColumn("payload_digest", F.when(F.col("record_id") == "urn:page:7", F.raise_error(F.lit("lost"))).otherwise(F.col("payload_digest")))
    with pytest.raises(Exception, match="lost"):
        warc.write_warc(broken, uri)
    assert ids(spark, uri) == ["urn:page:1"]
