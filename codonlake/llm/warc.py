"""WARC archives as a PySpark data source, both ways.

``spark.read.format("warc").option("path", folder)``: one partition per archive file (files are gzip with one member per
record, which cannot be entered in the middle). Filters on ``record_type``, ``record_id``, ``target_uri`` and
``payload_digest`` are pushed down: of every record only the header block is parsed first, and a record that fails a
filter is stepped over. The ``payloads`` option (``all``, ``none``) says whether payloads are wanted at all; payloads
of records that fail, or that nobody wants, are inflated past but never copied or decoded.

Archives of other writers are read too: header names in any case, folded header lines, records of every type, with or
without target, digest or date, packed (``.gz``) or plain. Ids of any form stand in ``record_uri`` and ``refers_to_uri``;
``record_id`` and ``refers_to`` hold the number where an id is one of this writer, else null. The payload of an HTTP
response is what follows its HTTP header; its size is null where nobody wants payloads and no header field tells it. A folder
with a manifest is read by it; without one all its ``.warc`` and ``.warc.gz`` files are read, in subfolders as well; a
path may also be one file.

``df.write.format("warc").option("path", folder)`` writes a file per partition. A revisit record holds a header block
and no payload; it names the record that it refers to. Files are named by partition and attempt and listed in the
manifest that the driver writes when all tasks are done, so an attempt that was lost leaves nothing that a reader sees.

Paths are URIs of any store that pyarrow opens (local folders, HDFS, S3, GCS). ``response_records`` decides between
response and revisit by the digest of the payload. A null payload counts as empty; repeated rows are written one by
one; null ids are kept as null; extra columns are ignored; an empty table gives an archive folder without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from codonlake.llm.common import join_hot, register, stored, table
from codonlake.session import ensure_checkpoint_dir, ship_package

SCHEMA = ("record_id long, record_type string, target_uri string, payload_digest string, refers_to long, "
          "payload_bytes long, payload binary, record_uri string, refers_to_uri string, content_type string")
MANIFEST = "manifest.json"
_CHUNK = 1 << 17
_URN = "urn:page:"
#: Columns whose filters are tested on the header block.
_HEADER_OF = ("record_type", "record_id", "target_uri", "payload_digest")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _urn(number) -> str:
    return f"<{_URN}{'' if number is None else number}>"


def _number(urn: str | None) -> int | None:
    """The number of an id of this writer, else null."""
    bare = (urn or "").strip("<>")
    digits = bare.removeprefix(_URN)
    return int(digits) if bare.startswith(_URN) and re.fullmatch(r"-?[0-9]{1,19}", digits) else None


def _line(value: str | None) -> str:
    """A header value on one line."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def member(record: dict) -> bytes:
    """One record as a gzip member."""
    payload = record["payload"] or b""
    fields = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", _urn(record["record_id"])), ("WARC-Target-URI", _line(record["target_uri"])),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{record['payload_digest']}")]
    if record["record_type"] == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _urn(record["refers_to"])), ("X-Payload-Length", str(record["payload_bytes"]))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


class Headers(dict):
    """Header fields, the first of each name; names in any case."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


class Members:
    """Reads record after record of a stream (gzip unless ``plain``): header first, payload on demand."""

    def __init__(self, stream, plain: bool = False):
        self.stream, self.plain, self.packed, self.ready, self.unpacker = stream, plain, b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.plain:
            out = self.stream.read(_CHUNK)
            self.ready += out
            return bool(out)
        while True:
            if not self.packed:
                self.packed = self.stream.read(_CHUNK)
                if not self.packed:
                    return False
            out = self.unpacker.decompress(self.packed, _CHUNK)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.packed = self.unpacker.unused_data
                self.unpacker = zlib.decompressobj(31)
            if out:
                self.ready += out
                return True

    def header(self) -> Headers | None:
        while True:
            while self.ready[:1] in (b"\r", b"\n"):  # some writers leave more blank lines between records
                del self.ready[:1]
            if (end := self.ready.find(b"\r\n\r\n")) >= 0:
                break
            if not self._more():
                if self.ready.strip():
                    raise ValueError("archive ends within a record")
                return None
        lines = re.sub(r"\r\n[ \t]+", " ", bytes(self.ready[:end]).decode(errors="replace")).split("\r\n")
        del self.ready[:end + 4]
        head = Headers()
        for name, colon, value in (line.partition(":") for line in lines[1:]):
            if colon:
                head.setdefault(name.strip().lower(), value.strip())
        return head

    def body(self, size: int, wanted: bool) -> bytes | None:
        """The payload if wanted, and the end of the record passed either way."""
        kept, left = (bytearray() if wanted else None), size
        while True:
            piece = min(left, len(self.ready))
            if wanted:
                kept += self.ready[:piece]
            del self.ready[:piece]
            left -= piece
            if not left:
                break
            if not self._more():
                raise ValueError("archive ends within a payload")
        while len(self.ready) < 4:
            if not self._more():
                raise ValueError("archive ends within a record")
        if self.ready[:4] == b"\r\n\r\n":
            del self.ready[:4]
        return bytes(kept) if wanted else None


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payloads", "all") != "none"
        self.tests: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over equality with constants on header fields; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_OF:
                name = f.attribute[0]
                values = {self._as_header(name, v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)}
                self.tests[name] = self.tests.get(name, values) & values
            else:
                yield f

    @staticmethod
    def _as_header(name: str, value) -> str:
        return {"record_id": _urn, "target_uri": _line}.get(name, str)(value)

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        kinds = {i.base_name: i for i in store.get_file_info([root, f"{root}/{MANIFEST}"])}
        if kinds.get(MANIFEST) is not None and kinds[MANIFEST].type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [ArchiveFile(f"{root}/{name}") for name in json.loads(f.read())["files"]]
        if store.get_file_info(root).type == fs.FileType.File:
            return [ArchiveFile(root)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [ArchiveFile(i.path) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: ArchiveFile | None):
        import pyarrow as pa

        if partition is None:  # no files at all
            return
        store, _ = _store(self.path)
        names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload", "record_uri", "refers_to_uri", "content_type"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        with store.open_input_stream(partition.path, compression=None) as f:
            members, rows, held = Members(f, plain=not partition.path.endswith(".gz")), [], 0
            while (head := members.header()) is not None:
                size, kind, content = int(head["Content-Length"]), head["WARC-Type"], head.get("Content-Type")
                digest = re.sub("^sha1:", "", head.get("WARC-Payload-Digest", ""), flags=re.IGNORECASE) or None
                field = {"record_type": kind, "record_id": head.get("WARC-Record-ID"), "target_uri": head.get("WARC-Target-URI"), "payload_digest": digest}
                passes = all(field[name] in values for name, values in self.tests.items())
                payload = members.body(size, passes and self.payloads and kind != "revisit")
                if passes:
                    http = (content or "").lower().startswith("application/http") and kind in ("response", "revisit")
                    if http and payload is not None:
                        payload = payload.partition(b"\r\n\r\n")[2]
                    told = head.get("X-Payload-Length")
                    length = int(told) if told else len(payload) if payload is not None else None if http else size
                    rows.append((_number(field["record_id"]), kind, field["target_uri"], digest, _number(head.get("WARC-Refers-To")), length, payload,
                                 (field["record_id"] or "").strip("<>") or None, (head.get("WARC-Refers-To") or "").strip("<>") or None, content))
                    held += len(payload or b"") + 200
                    if held > 32 * _CHUNK:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, records = f"{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as f:
            for row in iterator:
                f.write(member(row.asDict()))
                records += 1
        return Written(name, records)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps({"files": [m.name for m in messages if m and m.records]}).encode())

    def abort(self, messages) -> None:
        """Files without a manifest are invisible to readers."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def use_warc(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32 without a prefix: ten hexadecimal digits make eight of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def response_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records to write for pages (page_id, url, html): of equal payloads the largest page_id is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.encode("html", "UTF-8"))})
    groups = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
              .where("n > 1"))
    small = stored(groups)
    marked = join_hot(rows, small, "payload_digest", "n", max(1, int(small.agg(F.sum("n")).first()[0] or 0)), "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id") != F.col("last"))
    return marked.select(
        F.col("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        "payload_digest", F.when(revisit, F.col("last")).alias("refers_to"), "payload_bytes",
        F.when(~revisit, F.encode("html", "UTF-8")).alias("payload"))


def digest_of(payload: bytes) -> str:
    """The digest of a header, from bytes; for checks."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_members(data: bytes) -> list[tuple[dict, bytes]]:
    """All records of an archive file in memory; for checks."""
    members, out = Members(io.BytesIO(data)), []
    while (head := members.header()) is not None:
        out.append((head, members.body(int(head["Content-Length"]), True)))
    return out


_ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p),
d AS (SELECT page_id, n, last, s, list_transform(range(0, 4), lambda i: ('0x' || substr(s, i * 10 + 1, 10))::BIGINT) AS q FROM x)
SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""


@register("op1_warc_archive", _ORACLE)
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives, reads them back and takes size and digest from the payloads read."""
    use_warc(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    response_records(table(spark, sf_dir, "pages")).write.format("warc").option("path", path).mode("append").save()
    read = spark.read.format("warc").option("path", path)
    whole = read.load().where("record_type = 'response'").select(
        F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type", "refers_to")
    again = read.option("payloads", "none").load().where("record_type = 'revisit'").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    return whole.unionByName(again)
