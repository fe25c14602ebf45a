"""WARC archives as a Python data source: partitions of files, header predicates, payloads decoded only on demand."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage)

from parlance.llm.common import query, read
from parlance.runtime import checkpoint_dir, stored

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
          "headers map<string,string>, payload binary")
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
    ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
# The header behind each column that a predicate may be pushed to.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# A task starts a new file beyond this size; files of a scan are put together up to it.
FILE_BYTES = 128 << 20
CHUNK = 1 << 16


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


# --- records -----------------------------------------------------------------------------

def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member whose extra field holds its compressed and plain length, so that a reader can skip it."""
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = [f"{k}: {clean(v)}" for k, v in headers.items() if v is not None]
    data = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class _Member:
    """A record that is inflated, or read, only as far as asked. ``skip`` moves to the next one."""

    def __init__(self, stream, gzipped: bool):
        self.stream, self.at, self.gzipped = stream, stream.tell(), gzipped
        self.plain, self.size = b"", None
        if gzipped:
            head = stream.read(12)
            if len(head) == 12 and head[3] & 4:
                extra = stream.read(struct.unpack("<H", head[10:])[0])
                if extra[:4] == b"sl\x08\0":
                    self.size = struct.unpack("<I", extra[4:8])[0]
            stream.seek(self.at)
            self.inflater = zlib.decompressobj(31)

    def more(self) -> bool:
        """Read on; false at the end of the record's data."""
        if not self.gzipped:
            data = self.stream.read(CHUNK)
            self.plain += data
            return bool(data)
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail or self.stream.read(CHUNK)
        if not data:
            raise ValueError("a compressed record is cut short")
        self.plain += self.inflater.decompress(data, 4 * CHUNK)
        return True

    def headers(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.plain:
            if not self.more():
                if self.plain.strip():
                    raise ValueError("a record without a header end")
                return None
        head, self.plain = self.plain.lstrip(b"\r\n").split(b"\r\n\r\n", 1)
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}

    def block(self, length: int) -> bytes:
        parts, n = [self.plain], len(self.plain)
        while n < length:
            self.plain = b""
            if not self.more():
                raise ValueError("a record's block is cut short")
            parts.append(self.plain)
            n += len(self.plain)
        data = b"".join(parts)
        self.plain = data[length:]
        return data[:length]

    def skip(self, length: int) -> None:
        """To the start of the next record; the block, if it was not read, is neither inflated nor copied where its
        place is known."""
        if not self.gzipped:
            self.stream.seek(self.stream.tell() - len(self.plain) + length + 4)
        elif self.size:
            self.stream.seek(self.at + self.size)
        else:
            while not self.inflater.eof:
                self.plain = b""
                self.more()
            self.stream.seek(self.stream.tell() - len(self.inflater.unused_data))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(stream, wanted, decode: bool = True) -> Iterator[tuple]:
    """Rows of an archive. ``wanted(headers)`` is asked before a payload is decoded; a decoded one is verified."""
    while True:
        first = stream.read(2)
        if not first:
            return
        stream.seek(stream.tell() - len(first))
        member = _Member(stream, first == b"\x1f\x8b")
        h = member.headers()
        if h is None:
            return
        length = int(h["Content-Length"])
        rest = length
        if wanted(h):
            payload = None
            if decode and h.get("WARC-Type") != "revisit":
                payload, rest = member.block(length), 0
                if h.get("Content-Type", "").startswith("application/http"):
                    payload = payload.split(b"\r\n\r\n", 1)[-1]
                stated = h.get("WARC-Payload-Digest")
                if stated and stated.startswith("sha1:") and stated[5:] != digest_of(payload):
                    raise ValueError(f"payload and digest differ: {h.get('WARC-Record-ID')}")
            digest = h.get("WARC-Payload-Digest")
            yield (h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Target-URI"),
                   digest.removeprefix("sha1:") if digest else None, h.get("WARC-Refers-To"), list(h.items()), payload)
        member.skip(rest)


# --- the data source ---------------------------------------------------------------------

@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, values in self.tests:
            value = headers.get(HEADERS[name])
            if name == "payload_digest" and value:
                value = value.removeprefix("sha1:")
            if value is None or values is not None and value not in values:
                return False
        return True

    def partitions(self) -> list[_Files]:
        """Files by falling size, put together up to the size of a split."""
        fs, path = _filesystem(self.options["path"])
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        files = sorted(((f.size, f.path) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.base_name)), reverse=True)
        limit, out, size = int(self.options.get("splitbytes", FILE_BYTES)), [], 0
        for n, p in files:
            if not out or size + n > limit:
                out.append([])
                size = 0
            out[-1].append(p)
            size += n
        return [_Files(tuple(x)) for x in out] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.options["path"])
        decode = self.options.get("payload", "true").lower() == "true"
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for row in records(stream, self._wanted, decode):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit gives them their final ones, so a lost or doubled task
    leaves nothing in the archive."""

    def __init__(self, options: dict, overwrite: bool):
        self.options = options
        fs, path = _filesystem(options["path"])
        if overwrite and fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir_contents(path)
        fs.create_dir(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _filesystem(self.options["path"])
        limit, names, out, size = int(self.options.get("filebytes", FILE_BYTES)), [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size > limit:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/_{names[-1]}.part", compression=None), 0
                data = self._record(r)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(tuple(names))

    @staticmethod
    def _record(r: dict) -> bytes:
        payload = r["payload"]
        digest = r["payload_digest"] or (digest_of(payload) if payload is not None else None)
        headers = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": "1970-01-01T00:00:00Z",
                   "WARC-Target-URI": r["target_uri"], "WARC-Payload-Digest": digest and f"sha1:{digest}",
                   "WARC-Refers-To": r["refers_to"], **dict(r["headers"] or [])}
        if r["record_type"] == "revisit":
            headers["WARC-Profile"] = REVISIT_PROFILE
        if r["record_type"] in ("response", "revisit"):
            headers["Content-Type"] = "application/http;msgtype=response"
            return encode_record(headers, HTTP + (payload or b""))
        return encode_record(headers, payload or b"")

    def commit(self, messages: list[_Written | None]) -> None:
        fs, path = _filesystem(self.options["path"])
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{path}/_{name}.part", f"{path}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, path = _filesystem(self.options["path"])
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{path}/_{name}.part")


class WarcSource(DataSource):
    """``format("warc")``. Options: ``path``; ``payload`` (false: no payload is decoded), ``splitBytes``, ``fileBytes``.

    Reads gzipped archives with and without skip lengths, and plain ones.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of the archives under a folder. Equality, IN and NOT NULL on the header columns are tested before a
    payload is decoded."""
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


# --- pages -------------------------------------------------------------------------------

def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """A record for every page. Of pages of equal payloads of at least ``min_bytes`` bytes the one of the largest id
    is the response, the others revisit it. A null html is an empty payload, a null id is below all others; of
    repeated rows of the largest id one is the response."""
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"),
                        F.octet_length(body).cast("bigint").alias("bytes"))
    each = rows.filter(F.col("bytes") >= min_bytes).select("sha1", "id").groupBy("sha1", "id").agg(F.count("*").alias("n"))
    top = stored(each.groupBy("sha1").agg(F.max(F.struct("id", "n")).alias("top")).select(
        "sha1", F.col("top.id").alias("top"), F.col("top.n").alias("n")))
    out = rows.join(top, "sha1", "left").withColumn("first", F.col("n").isNull() | F.col("id").eqNullSafe(F.col("top")))
    if not top.filter("n > 1").isEmpty():
        twice = (F.col("n") > 1) & F.col("first")
        first = F.row_number().over(Window.partitionBy("sha1").orderBy("url")) == 1
        out = out.filter(~F.coalesce(twice, F.lit(False))).unionByName(out.filter(twice).withColumn("first", first))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return out.select(
        urn(F.col("id")).alias("record_id"), F.when(F.col("first"), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"), _base32(F.col("sha1")).alias("payload_digest"),
        F.when(~F.col("first"), urn(F.col("top"))).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.col("bytes").cast("string")).alias("headers"),
        F.when(F.col("first"), F.col("payload")).alias("payload"))


def _base32(hexes: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: eight characters for every ten digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hexes, 10 * g + 1, 10), 16, 10).cast("bigint") for g in range(4)]
    five = lambda n, i: F.substring(F.lit(letters), (F.shiftright(n, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*[five(n, i) for n in groups for i in range(8)])


def page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


_DIGEST = "[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((part[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(0, 32)]"
_OP8_SQL = f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
first AS (
  SELECT page_id, html, sha, row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) = 1 AS response,
         max(page_id) OVER (PARTITION BY sha) AS top,
         [('0x' || substr(sha, k, 10))::BIGINT FOR k IN [1, 11, 21, 31]] AS part FROM hashed)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string({_DIGEST}, '') AS payload_digest,
       CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT response THEN top END AS refers_to
FROM first"""


@query("op8_warc_round_trip", _OP8_SQL)
def _op8(spark, sf_dir):
    register(spark)
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    page_records(read(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).save()
    return read_warc(spark, path).select(
        page_id(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), F.element_at("headers", "X-Payload-Length").cast("bigint")).alias("payload_bytes"),
        "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"))
