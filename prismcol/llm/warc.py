"""WARC archives: a PySpark data source that writes and reads them."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import materialise, new_path, small

SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
DATE = "2024-01-01T00:00:00Z"  # of all records: the pages carry none, and reruns are to agree
FILE_BYTES = 64 << 20
HEAD = 1 << 16  # bytes of a record that are inflated to find its headers
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Of a URI or local path; any store that Arrow reaches."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def _member(record: bytes) -> bytes:
    """A gzip member that says in its extra field 'sl' how long it is, packed and unpacked, so that readers can skip it."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + (12).to_bytes(2, "little") + extra + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(page_id: str | None, url: str | None, record_type: str, refers_to: str | None, length: int, sha1: str, payload: bytes | None) -> bytes:
    """A WARC/1.1 record: a response with HTTP headers and payload, or a revisit with the headers alone, which keep the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    named = lambda x: f"<urn:x-page:{json.dumps(x)[1:-1]}>"
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha1}')}>"]
    head += [f"X-Page: {named(page_id)}"] if page_id is not None else []
    head += [f"WARC-Target-URI: {json.dumps(url, ensure_ascii=False)[1:-1]}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(refers_to)}"] if record_type == "revisit" and refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Committed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes gzip-packed archives of bounded size. Each task attempt has file names of its own; a manifest of each write names those of the attempts that won."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")), batch.column("payload"), strict=True):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        files.append((name, size))
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                packed = _member(record(*row[:-1], row[-1].as_py() if row[2] == "response" else None))
                out.write(packed)
                size += len(packed)
        if out is not None:
            out.close()
            files.append((name, size))
        return _Committed(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        # A manifest for each write, so that a folder may be written to again.
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                fs.delete_file(f"{base}/{name}")


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Record:
    """A record's bytes, as many as are asked for; the rest is neither read nor inflated."""

    def __init__(self, more) -> None:
        self.more, self.head = more, b""

    def find(self, mark: bytes, start: int = 0) -> int:
        """Where ``mark`` is, from ``start`` on; -1 where the record has none."""
        while (at := self.head.find(mark, start)) < 0:
            if not self._read():
                break
        return at

    def upto(self, end: int) -> bytes:
        while len(self.head) < end and self._read():
            pass
        return self.head[:end]

    def _read(self) -> bool:
        got = self.more()
        self.head += got
        return bool(got)


class WarcReader(DataSourceReader):
    """Reads archives file by file. Headers are parsed first; a record that a pushed predicate rules out, and a payload that the
    option ``payload=false`` leaves out, are skipped: the rest of a member is not inflated where its length is known."""

    PUSHED = {"record_type": "warc-type", "url": "warc-target-uri", "page_id": "x-page"}

    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.equal[column] = self.equal[column] & values if column in self.equal else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = _filesystem(self.path)
        found = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(base))]
        names = []
        manifests = sorted(x for x in found if x.startswith("manifest-") and x.endswith(".json"))
        for manifest in manifests:
            with fs.open_input_stream(f"{base}/{manifest}") as f:
                names += [name for name, _ in json.loads(f.read())]
        if not manifests:
            names = sorted(x for x in found if x.endswith((".warc", ".warc.gz")))
        return [_Files([n]) for n in names] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, base = _filesystem(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{base}/{name}") as f:
                yield from self._packed(f) if name.endswith(".gz") else self._plain(f)

    def _packed(self, f) -> Iterator[tuple]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            first = f.read(min(HEAD, end - at))
            size = int.from_bytes(first[16:20], "little") if first[3] & 4 and first[12:14] == b"sl" else None
            z, given = zlib.decompressobj(31), [first]

            def more() -> bytes:
                got = b""
                while not got and not z.eof:  # noqa: B023
                    data = given.pop() if given else z.unconsumed_tail or f.read(HEAD)  # noqa: B023
                    if not data:
                        break
                    got = z.decompress(data, 1 << 20)  # noqa: B023
                return got

            record = _Record(more)
            row = self._row(record)
            if row is not None:
                yield row
            if size is None:
                while more():
                    pass
                at = f.tell() - len(z.unused_data)
            else:
                at += size

    def _plain(self, f) -> Iterator[tuple]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            record = _Record(lambda: f.read(HEAD))
            row = self._row(record)
            if row is not None:
                yield row
            headers, start = _headers(record)
            at += start + int(headers["content-length"]) + 4

    def _row(self, record: _Record) -> tuple | None:
        headers, start = _headers(record)
        kind = headers["warc-type"]
        if not all(_value(headers, self.PUSHED[c]) in values for c, values in self.equal.items()):
            return None
        end = start + int(headers["content-length"])
        body, length = start, None
        if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
            mark = record.find(b"\r\n\r\n", start)
            http = record.head[start : mark if 0 <= mark < end else end]
            body = min(mark + 4, end) if mark >= 0 else end
            length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if length is None:
            length = end - body
        digest = headers.get("warc-payload-digest", "")
        sha1 = base64.b32decode(digest.partition(":")[2]).hex() if digest.startswith("sha1:") else None
        payload = record.upto(end)[body:end] if self.payload and kind != "revisit" else None
        if payload is not None and sha1 is not None and hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError(f"a record's payload does not have its digest: {headers.get('warc-record-id')}")
        return _value(headers, "x-page"), _value(headers, "warc-target-uri"), kind, _value(headers, "warc-refers-to"), length, sha1, payload


def _headers(record: _Record) -> tuple[dict[str, str], int]:
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without an end of its headers")
    lines = record.head[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def _value(headers: dict[str, str], key: str) -> str | None:
    v = headers.get(key)
    if v is None:
        return None
    if v.startswith("<urn:x-page:"):
        return json.loads(f'"{v[12:-1]}"')
    return json.loads(f'"{v}"') if key == "warc-target-uri" and "\\" in v else v


class WarcDataSource(DataSource):
    """``format("warc")``: option ``path``; for reading also ``payload`` (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def classify_records(pages: DataFrame, least: int = LEAST_REVISIT, most: int = 200_000) -> DataFrame:
    """The rows of an archive of ``pages``: of equal payloads of ``least`` bytes or more, the one of the largest page_id is the response that the others revisit.

    A null html is an empty payload. Rows that tie for the largest page_id are all responses; a null page_id is below all others. Revisits
    are found from digests and ids alone; they are broadcast where there are at most ``most`` of them, else rows are joined to them by digest and id, so copies
    of one payload do not meet in one task.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), payload.alias("payload"))
    keys = materialise(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest"), "digests")
    last = keys.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(last, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "last", F.lit(True).alias("again")).distinct()
    again, _ = small(materialise(again, "revisits"), most)
    revisit = F.coalesce("again", F.lit(False))
    return rows.join(again, rows["page_id"].eqNullSafe(again["p"]) & (rows["payload_digest"] == again["d"]), "left").select(
        F.col("page_id").cast("string"), F.col("url").cast("string"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last").cast("string")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (``page_id, url, html``) at ``path``, a folder that driver and executors reach; extra columns are left out."""
    pages.sparkSession.dataSource.register(WarcDataSource)
    classify_records(pages).write.format("warc").mode("append").save(path=path)


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives at ``path``, of whatever type. A filter by record_type, url or page_id is applied to headers, before payloads are decoded.

    The payload of a response is its body, that of a revisit null, that of another type its block. Without a manifest of ``write_warc`` all files that end
    in .warc or .warc.gz are read. The session's filter pushdown to Python sources is switched on, and stays so, as plans are made later.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path=path)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` in the shared folder; give all records as they are read back.

    Responses are read with their payloads, which are checked against their digests; revisits by a pushed predicate and without, so that responses' payloads are not inflated again.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).where("record_type = 'response'").unionByName(read_warc(spark, path, payload=False).where("record_type = 'revisit'"))
