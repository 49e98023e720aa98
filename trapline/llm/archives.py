"""Content-addressed web archives.

Payloads are kept once by their digest: of all pages with the same payload, the one with the
least id becomes a ``response`` record that holds it, the others become ``revisit`` records
that name it. ``write`` lays the records down as WARC 1.1 files, ``read`` takes such files apart
again, and ``reconstruct`` gives every page its payload back by joining the headers to the payloads.

Digests are verified twice: while writing, payloads that share a SHA-256 must also share their
SHA-1 and size; while reading, the digests that a record states must be those of its bytes.

A file's records are lines of a text file whose line end is the two empty lines that end a
record, so Spark writes them as they are. They are whole-file gzip and named ``*.txt.gz``.
A file takes as many records as make ``file_bytes`` on average, and whoever reads it holds it whole.

Defined cases: null payloads are empty; payloads shorter than ``least_bytes`` are always kept
in their own record; a null url has no target line; control characters and blanks in a url are
percent-encoded; a null id is a page of its own that comes after all others; of pages with one
id the one with the least url comes first; equal rows are numbered, and the first of them counts;
empty tables give an empty archive. Only the named columns are read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from trapline.llm import common
from trapline.session import materialise

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
RECORD = "type string, record_id string, refers_to string, sha256 string, sha1 string, header string, http string, payload binary, damage string"


def base32(sha1_hex: Column) -> Column:
    """A SHA-1 in bare upper-case base32: five hex digits make four letters."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digests(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("size")]


def _urn(key: Column, tag: Column, copy: Column) -> Column:
    name = F.coalesce(F.url_encode(key.cast("string")), F.lit("(none)"))
    return F.concat(F.lit("<urn:page:"), name, F.lit(":"), tag, F.lit(":"), copy.cast("string"), F.lit(">"))


def page_id(record_id: Column, kind: DataType | str) -> Column:
    """The page's id out of its record's."""
    name = F.regexp_extract(record_id, "^<urn:page:(.*):[0-9a-f]+:[0-9]+>$", 1)
    return F.when(name != "(none)", F.url_decode(name)).cast(kind)


def _safe(url: Column) -> Column:
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _lines(*lines: Column) -> Column:
    return F.concat_ws(END, *lines)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _payload(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def headers(df: DataFrame, *, id_col: str, url_col: str, payload_col: str, least_bytes: int, date: str) -> DataFrame:
    """The records apart from payloads: ``type, record_id, refers_to, sha256, size, header, http, payload``.

    ``payload`` is there for those shorter than ``least_bytes`` only. Stored, as both the records and the
    number of files come from it.
    """
    payload = _payload(df, payload_col)
    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.when(url.rlike(r"[\x00-\x20\x7f]"), _safe(url)).otherwise(url).alias("url"),
                     F.when(F.octet_length(payload) < least_bytes, payload).alias("payload"), *digests(payload))
    rows = rows.groupBy("id", "url", "sha256", "sha1", "size", "payload").agg(F.count("*").alias("copies"))
    # Pages of one id differ in url or payload; equal ones are numbered.
    rows = rows.withColumn("tag", F.substring(F.md5(F.concat_ws(" ", "sha256", "url")), 1, 16))
    key = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("url"), F.col("tag"))
    same = F.min("sha1").eqNullSafe(F.max("sha1")) & F.min("size").eqNullSafe(F.max("size"))
    firsts = rows.groupBy("sha256").agg(
        F.min(key).alias("first"), F.when(~same, F.raise_error(F.lit("different payloads have the same SHA-256"))).alias("clash"))
    rows = (rows.join(firsts, "sha256").where(F.col("clash").isNull())
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))))
    own = (F.col("size") < least_bytes) | (key.eqNullSafe(F.col("first")) & (F.col("copy") == 0))
    rows = rows.select(
        F.when(own, "response").otherwise("revisit").alias("type"), _urn(F.col("id"), F.col("tag"), F.col("copy")).alias("record_id"),
        F.when(~own, _urn(F.col("first.id"), F.col("first.tag"), F.lit(0))).alias("refers_to"), "url", "sha256", "sha1", "size", "payload")
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _line("Content-Length", F.col("size").cast("string")), F.lit(END))
    rows = rows.withColumn("http", http)
    length = F.octet_length("http") + F.when(F.col("type") == "response", F.col("size")).otherwise(0)
    header = _lines(
        F.lit("WARC/1.1"), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", F.col("record_id")), F.lit(f"WARC-Date: {date}"),
        _line("WARC-Target-URI", F.col("url")), F.when(F.col("type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        _line("WARC-Refers-To", F.col("refers_to")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Payload-SHA256", F.col("sha256")), F.lit("Content-Type: application/http; msgtype=response"),
        _line("Content-Length", length.cast("string")), F.lit(END))
    return materialise(rows.select("type", "record_id", "refers_to", "sha256", "size", header.alias("header"), "http", "payload"), "headers")


def write(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every row as WARC files below ``folder``; returns the records without payloads."""
    known = headers(df, id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes, date=date)
    held = F.octet_length("header") + F.octet_length("http") + F.when(F.col("type") == "response", F.col("size")).otherwise(0)
    mean = known.agg(F.avg(held)).first()[0] or 1
    payload = _payload(df, payload_col)
    # Each task keeps one payload of a digest before they are dealt out; headers come to them.
    payloads = df.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    payloads = payloads.groupBy("sha256").agg(F.first("payload").alias("payload"))
    large = (F.col("type") == "response") & F.col("payload").isNull()
    records = known.where(large).drop("payload").join(payloads, "sha256")
    records = records.unionByName(known.where(~large).withColumn("payload", F.coalesce("payload", F.lit(b""))))
    value = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), F.col("payload")).cast("string")
    (records.select(value.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(folder))
    return known


def _fields(header: bytes) -> dict[bytes, str]:
    lines = (line.partition(b":") for line in header.split(b"\r\n")[1:])
    return {name.lower(): value.strip().decode("utf-8", "replace") for name, colon, value in lines if colon}


def _taken_apart(data: bytes):
    """Each record of a file as the fields of ``RECORD``; the first damage ends it and is named."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        fields = _fields(data[at:stop]) if stop >= 0 and data.startswith(b"WARC/", at) else {}
        size = fields.get(b"content-length", "")
        if not size.isdecimal():
            yield (None,) * 8 + (f"no record at byte {at}",)
            return
        begin, end = stop + 4, stop + 4 + int(size)
        if data[end:end + 4] != b"\r\n\r\n":
            yield (None,) * 8 + (f"the record at byte {at} does not end where it says",)
            return
        http = begin
        if fields.get(b"content-type", "").startswith("application/http"):
            found = data.find(b"\r\n\r\n", begin, end)
            http = found + 4 if found >= 0 else begin
        digest = fields.get(b"warc-payload-digest", "")
        kind = fields.get(b"warc-type")
        yield (kind, fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"payload-sha256"),
               digest[5:] if digest.lower().startswith("sha1:") else None, data[at:begin].decode("utf-8", "replace"),
               data[begin:http].decode("utf-8", "replace"), None if kind == "revisit" else data[http:end], None)
        at = end + 4


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of WARC files, as in ``RECORD``; a revisit has no payload. Damage has a row of its own that says where."""
    schema = [pa.string()] * 7 + [pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), schema)], names)

    def run(batches):
        for files in batches:
            for content in files.column("content"):
                data = content.as_py()
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for row in _taken_apart(data):
                    rows.append(row)
                    held += len(row[7] or b"") + 1000
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def verified(records: DataFrame) -> DataFrame:
    """``records`` with the payload's digests as computed; a record whose digests are others, or damage, ends the job."""
    payload = F.col("payload")
    sha256, sha1, size = digests(payload)
    told = F.col("sha256").isNull() | (F.col("sha256") == sha256)
    told &= F.col("sha1").isNull() | (F.col("sha1") == sha1)
    wrong = F.coalesce(F.col("damage"), F.when(payload.isNotNull() & ~told, F.concat(F.lit("not the payload it states: "), F.col("record_id"))))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.when(payload.isNotNull(), sha256).otherwise(F.col("sha256")))
    return records.select("type", "record_id", "refers_to", checked.cast("string").alias("sha256"), "header", "http", "payload",
                          F.when(payload.isNotNull(), sha1).alias("sha1"), F.when(payload.isNotNull(), size).alias("size"))


def reconstruct(records: DataFrame) -> DataFrame:
    """``verified`` records with the payload of every one: a revisit's is that of the record it refers to.

    Of ``payload, sha1, size`` only the columns given are joined. A digest that a third of all
    records share is one row on the side of the payloads, so a join may split its records.
    """
    carried = [c for c in ("payload", "sha1", "size") if c in records.columns]
    own = records.where(F.col("size").isNotNull())
    held = own.select(F.col("record_id").alias("refers_to"), "sha256", *carried)
    joined = records.where(F.col("size").isNull()).drop(*carried).join(held, ["refers_to", "sha256"], "left")
    lost = F.raise_error(F.concat(F.lit("no record holds the payload of "), F.col("record_id"))).cast("long")
    return own.unionByName(joined.withColumn("size", F.when(F.col("size").isNull(), lost).otherwise(F.col("size"))).select(own.columns))
