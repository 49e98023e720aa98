"""Web archives: written, read back, and held against the pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trapline.llm import archives
from trapline.session import scratch_path

SCHEMA = "page_id long, url string, html string, id string, type string, payload string, sha256 string, copy int"
EXTRA = ("x", "x", "x", "x", 1)
ENDED = "text that ends a record\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, "http://a/9", "same"), (4, None, "other"), (7, "http://a/7", None), (8, "http://a/8", ""),
    (1, "http://a/ b\r\nInjected: yes\x7f", ENDED), (2, "http://ü/é?%0A", "Ünïcode 🙂 \x00\r\n"), (None, "http://n/", "same"), (None, "http://n/", "unseen"),
    (11, "http://twice/", "twice"), (11, "http://twice/", "twice"), (12, "http://b/", "by url"), (12, "http://a/", "by url"), (13, "http://long/", "long " * 200_000),
]


def stored(spark, pages, name, **options):
    folder = scratch_path(spark, name)
    df = spark.createDataFrame([(*p, *EXTRA) for p in pages], SCHEMA).repartition(3)
    archives.write(df, folder, **options)
    return folder


def sha1_32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(pages, least=0):
    """Type and reference by the definition: the first of equal payloads answers, those shorter than ``least`` all do."""
    order = sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] is not None, p[1] or ""))
    first, out = {}, []
    for page, url, html in order:
        data = (html or "").encode()
        own = len(data) < least or data not in first
        out.append((page, len(data), sha1_32(data), "response" if own else "revisit", None if own else first[data]))
        first.setdefault(data, page)
    return sorted(out, key=repr)


def rows_of(records):
    return sorted(map(tuple, records.select(
        archives.page_id(F.col("record_id"), "long"), "size", "sha1", "type", archives.page_id(F.col("refers_to"), "long")).collect()), key=repr)


@pytest.mark.parametrize("least, file_bytes", [(0, 32 << 20), (0, 1), (5, 2_000), (10**9, 32 << 20)])
def test_pages_come_back(spark, least, file_bytes):
    folder = stored(spark, PAGES, "warc", least_bytes=least, file_bytes=file_bytes)
    records = archives.verified(archives.read(spark, folder))
    whole = archives.reconstruct(records).cache()
    assert rows_of(whole) == plain(PAGES, least)
    payloads = sorted((bytes(r["payload"]) for r in whole.collect()))
    assert payloads == sorted((p[2] or "").encode() for p in PAGES)
    held = records.where("type = 'response'").groupBy("sha256").count().where(f"count > 1 AND {least} = 0")
    assert held.count() == 0
    whole.unpersist()


def test_files_are_warc(spark):
    """Taken apart by nothing but the format's rules: version line, named fields, block by its length, two empty lines."""
    folder = stored(spark, PAGES, "warc")
    seen = []
    for path in Path(folder.removeprefix("file:")).glob("*.txt.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            block, rest = data[:int(fields["Content-Length"])], data[int(fields["Content-Length"]):]
            assert version == "WARC/1.1" and rest.startswith(b"\r\n\r\n") and "Injected" not in fields
            http, payload = block.split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + sha1_32(payload) and fields["Payload-SHA256"] == hashlib.sha256(payload).hexdigest()
            else:
                assert payload == b"" and fields["WARC-Profile"] == archives.PROFILE
            seen.append(fields["WARC-Record-ID"])
            data = rest[4:]
    assert len(seen) == len(set(seen)) == len(PAGES)


def test_headers_are_kept_exactly(spark):
    folder = stored(spark, PAGES, "warc")
    read = {r["record_id"]: (r["header"], r["http"]) for r in archives.read(spark, folder).collect()}
    df = spark.createDataFrame([(*p, *EXTRA) for p in PAGES], SCHEMA)
    known = archives.headers(df, id_col="page_id", url_col="url", payload_col="html", least_bytes=0, date="2000-01-01T00:00:00Z")
    assert {r["record_id"]: (r["header"], r["http"]) for r in known.collect()} == read


def test_text_ids_and_bytes(spark):
    rows = [("a b/ü", "u", bytearray(b"\xff\xfe\x00")), ("", "u", bytearray(b"\xff\xfe\x00")), (None, "u", None)]
    folder = scratch_path(spark, "warc")
    archives.write(spark.createDataFrame(rows, "page_id string, url string, html binary"), folder)
    whole = archives.reconstruct(archives.verified(archives.read(spark, folder)))
    got = {r[0]: (bytes(r[1]), r[2], r[3]) for r in whole.select(
        archives.page_id(F.col("record_id"), "string"), "payload", "type", archives.page_id(F.col("refers_to"), "string")).collect()}
    assert got == {"": (b"\xff\xfe\x00", "response", None), "a b/ü": (b"\xff\xfe\x00", "revisit", ""), None: (b"", "response", None)}


def test_empty_table(spark):
    folder = stored(spark, [], "warc")
    assert archives.reconstruct(archives.verified(archives.read(spark, folder))).count() == 0


def broken(spark, tmp_path, change):
    folder = stored(spark, [(1, "http://a/", "payload one"), (2, "http://b/", "payload two")], "warc")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(folder.removeprefix("file:")).glob("*.txt.gz")))
    (tmp_path / "whole.warc").write_bytes(change(data))
    return archives.read(spark, str(tmp_path / "whole.warc"))


def test_damage_is_listed_and_ends_a_checked_read(spark, tmp_path):
    cut = broken(spark, tmp_path, lambda data: data[:-9])
    assert [r["damage"] is None for r in cut.collect()] == [True, False]
    with pytest.raises(Exception, match="does not end where it says"):
        archives.verified(cut).collect()


def test_payloads_are_held_against_their_digests(spark, tmp_path):
    changed = broken(spark, tmp_path, lambda data: data.replace(b"payload two", b"payload 2wo"))
    with pytest.raises(Exception, match="not the payload it states"):
        archives.verified(changed).collect()


def test_a_lost_payload_is_named(spark):
    records = archives.verified(archives.read(spark, stored(spark, PAGES, "warc")))
    with pytest.raises(Exception, match="no record holds the payload of"):
        archives.reconstruct(records.where("type = 'revisit'")).collect()
