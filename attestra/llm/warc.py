"""WARC files as a Python data source, and archives of pages in which equal payloads are kept once.

Reading: the driver plans one partition for a file. A task parses a record's header first; record types, ids, urls and digests that
a query's filters rule out are decided there, and the block of such a record, or of any where payloads aren't wanted, is passed over
by its length without being read (in a gzip file it is inflated, but not kept). Writing: each task attempt writes files of its own, and a commit names those of the attempts that
counted in a manifest, which readers follow; files of lost attempts are never read. Paths may be of any store that pyarrow.fs opens.

A response's block is an HTTP head and the payload; a revisit's is the head alone, whose Content-Length is the payload's.

Defined cases: a null html is an empty payload; of pages with equal payloads that share the smallest page_id all are responses; a
null page_id is written as an id without a number and is read as null; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from attestra.llm import staging

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
ROLL_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "_manifest"
_MARK = "X-Line-Breaks-Escaped"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:", "", 1) if path.startswith("file:/") else path)


def _clean(v: str) -> str:
    """A header's value on one line."""
    return v.replace("\r", "%0D").replace("\n", "%0A")


def _escaped(v: str) -> str:
    return _clean(v.replace("%", "%25"))


def _plain(v: str) -> str:
    return v.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if revisit else len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response"]
    if row["target_uri"] is not None:
        # a url is written as it is, but for one that has line breaks, which a header of ours marks
        broken = _clean(row["target_uri"]) != row["target_uri"]
        lines.append(f"WARC-Target-URI: {_escaped(row['target_uri']) if broken else row['target_uri']}")
        lines += [f"{_MARK}: target-uri"] if broken else []
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest'] or payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {_REVISIT}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream, accept, want_payload: bool, verify: bool = False) -> Iterator[dict]:
    """The records of an open file whose header fields accept(fields) takes. verify: a payload that is read must have its header's SHA-1."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        raw = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and raw:  # a folded header goes on
                raw[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            raw[name] = value.strip()
        length = int(raw["content-length"])
        fields = {k: raw.get(h.lower()) for k, h in _HEADERS.items()}
        for k in ("record_id", "refers_to"):
            fields[k] = fields[k][1:-1] if fields[k] and fields[k][0] == "<" else fields[k]
        if _MARK.lower() in raw and fields["target_uri"] is not None:
            fields["target_uri"] = _plain(fields["target_uri"])
        if fields["payload_digest"]:
            fields["payload_digest"] = fields["payload_digest"].rpartition(":")[2]
        if not accept(fields):
            _skip(stream, length)
            continue
        http = raw.get("content-type", "").startswith("application/http")
        left, size = length, length
        if http:
            size = None
            while left > 0:
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    size = int(value)
            size = left if fields["record_type"] != "revisit" or size is None else size
        payload = None
        if want_payload and fields["record_type"] != "revisit":
            payload = stream.read(left)
            if verify and payload_digest(payload) != fields["payload_digest"]:
                raise ValueError(f"a payload isn't what its digest says: {fields['record_id']}")
        else:
            _skip(stream, left)
        yield fields | {"payload_bytes": size, "payload": payload}


def _skip(stream, n: int) -> None:
    if n and stream.seekable() and not isinstance(stream, gzip.GzipFile):
        stream.seek(n, 1)
    else:
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.want_payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "false").lower() == "true"
        self.equal: dict[str, set] = {}
        self.starts: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal[name] & values if name in self.equal else values
            elif name in _HEADERS and isinstance(f, StringStartsWith):
                self.starts.append((name, f.value))
            else:
                yield f

    def accept(self, fields: dict) -> bool:
        return all(fields[k] in v for k, v in self.equal.items()) and all(fields[k] is not None and fields[k].startswith(v) for k, v in self.starts)

    def partitions(self):
        fs, path = open_fs(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [_File(self.path)]
        found = fs.get_file_info(pafs.FileSelector(path))
        manifests = [x.path for x in found if x.base_name.startswith(MANIFEST)]
        if manifests:
            names = [n for m in manifests for n in json.loads(fs.open_input_stream(m).read())]
        else:
            names = [x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return [_File(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, path = open_fs(partition.path)
        with fs.open_input_file(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            rows, size = [], 0
            for r in parse(stream, self.accept, self.want_payload, self.verify):
                rows.append(r)
                size += 500 + len(r["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.gz = options.get("compression", "none").lower() == "gzip"

    def write(self, iterator):
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}")
                    out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                raw = record(row)
                raw = gzip.compress(raw, 6, mtime=0) if self.gz else raw
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages):
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        fs, path = open_fs(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """Options: path; payload (false: leave payloads out); verify (true: digests are checked); compression (none or gzip, for writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    staging.prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record for each page: of equal payloads of min_bytes or more, the smallest page_id's is the response that others revisit."""
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("same", F.sha2("payload", 256))
    first = page.where(F.col("payload_bytes") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first")).where("first is not null")
    met = page.join(first.hint("rebalance"), "same", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return met.select(name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, name("first")).alias("refers_to"), F.sha1("payload").alias("sha1"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def _base32(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = [base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("sha1").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "payload_digest" else b.column(n) for n in _ARROW.names], _ARROW.names)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    """Write an archive of pages (page_id, url, html)."""
    register(pages.sparkSession)
    page_records(pages, min_bytes).mapInArrow(_base32, SCHEMA).write.format("warc").mode("append").option("compression", compression).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a row for each record of an archive of pages."""
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    r = read_warc(spark, path, verify=True).where(F.col("record_type").isin("response", "revisit"))
    checked = F.when((F.col("record_type") == "revisit") | (F.octet_length("payload") == F.col("payload_bytes")), F.col("payload_bytes"))
    return r.select(number("record_id").alias("page_id"), checked.alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
