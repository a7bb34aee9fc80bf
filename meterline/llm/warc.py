"""WARC archives as a Spark data source written in Python.

Writing: each task rolls files of bounded size; every record is a gzip member of its own, whose extra field "sl" holds the
member's length. Reading: files become partitions, of whichever writer, plain or gzip; equality and IN predicates on headers are
pushed down; a record's headers are read first, and where the predicates or the schema don't want its payload the reader jumps
over it (in plain files and by "sl"), or else inflates it without keeping it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import new_path, small_batches, stage

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload binary"
#: Column of the table, header of the record.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_committed.json"
PROFILE = b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field says how long the member is."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 8 + len(body) + len(end)
    if size >= 1 << 32:  # too long for the field
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + b"sl" + struct.pack("<HI", 4, size) + body + end


def record(row: dict) -> bytes:
    payload = row["payload"]
    block = HTTP + (payload if payload is not None and row["record_type"] == "response" else b"")
    lines = [b"WARC/1.1"]
    lines += [f"{name}: {str(row[c]).replace('\r', '').replace('\n', '')}".encode("utf-8", "replace") for c, name in HEADERS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append(PROFILE)
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    files.append([name, size])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return _Written(files)

    def commit(self, messages) -> None:
        """Only files of committed tasks count; what lost attempts wrote isn't in the manifest."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(f"{root}/{name}")


class _Files(InputPartition):
    def __init__(self, files):
        self.files = files


class _Plain:
    """Bytes of a file as they are."""

    def __init__(self, f):
        self.f, self.held, self.size = f, b"", f.size()

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, which is read too; all that is left where there is none."""
        at = 0
        while (found := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            more = self.more()
            if not more:
                out, self.held = self.held, b""
                return out
            self.held += more
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def more(self) -> bytes:
        return self.f.read(min(CHUNK, self.size - self.f.tell()))

    def begin(self) -> bool:
        """Go to the next record; False at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return True
            self.held = self.more()
            if not self.held:
                return False

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n:
            more = self.more()
            if not more:
                raise ValueError("a record ends before its Content-Length")
            parts.append(more[: n - have])
            self.held = more[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        over = n - len(self.held)
        self.held = self.held[n:]
        if over > 0:
            self.f.seek(min(self.size, self.f.tell() + over))


class _Gzip(_Plain):
    """Bytes of a file's gzip members, one after the other."""

    def __init__(self, f):
        super().__init__(f)
        self.raw, self.z, self.end = b"", None, None

    def more(self) -> bytes:
        while True:
            if not self.raw:
                self.raw = super().more()
                if not self.raw:
                    return b""
            if self.z is None:
                self.raw += super().more() if len(self.raw) < 20 else b""
                start = self.f.tell() - len(self.raw)
                known = self.raw[:4] == b"\x1f\x8b\x08\x04" and self.raw[12:14] == b"sl" and len(self.raw) >= 20
                self.end = start + struct.unpack_from("<I", self.raw, 16)[0] if known else None
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = None
            if out:
                return out

    def skip(self, n: int) -> None:
        """A member that says how long it is holds one record: what is left of it isn't inflated."""
        if self.end is not None and self.z is not None and n > len(self.held):
            self.f.seek(self.end)
            self.held, self.raw, self.z = b"", b"", None
            return
        over = n - len(self.held)
        self.held = self.held[n:]
        while over > 0:
            more = self.more()
            if not more:
                return
            self.held, over = more[over:], over - len(more)


class WarcReader(DataSourceReader):
    def __init__(self, schema, path: str, split: int):
        self.names = [f.name for f in schema.fields]
        self.path, self.split, self.wanted = path, split, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted.get(name, values)
            else:
                yield f

    def partitions(self):
        """Files in groups of about `split` bytes: those that a manifest names, or else the .warc and .warc.gz files under the path."""
        system, root = file_system(self.path)
        groups, size = [], self.split
        for name, n in sorted(_listed(system, root)):
            if size + n > self.split:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        types = {n: pa.binary() if n == "payload" else pa.string() for n in self.names}
        rows, held = [], 0
        for name in partition.files:
            with system.open_input_file(name) as f:
                for row in self._records(f):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 4 << 20:
                        yield self._batch(rows, types)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, types)

    def _batch(self, rows, types):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()], names=list(types))

    def _records(self, f) -> Iterator[dict]:
        first = f.read(min(2, f.size()))
        f.seek(0)
        source = _Gzip(f) if first == b"\x1f\x8b" else _Plain(f)
        while source.begin():
            version, *lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            named: dict[str, str] = {}
            for line in lines:
                name, _, value = line.partition(":")
                named[name.strip().lower()] = value.strip()
            if "content-length" not in named:
                raise ValueError("a record without Content-Length")
            length = int(named["content-length"])
            row = {c: named.get(h.lower()) for c, h in HEADERS.items()}
            kept = all(row[c] in v for c, v in self.wanted.items())
            if kept and "payload" in self.names and row["record_type"] != "revisit":
                block = source.take(length)
                http = named.get("content-type", "").lower().startswith("application/http")
                row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
            else:
                source.skip(length)
            if kept:
                yield row


def _listed(system, root: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the archives under a folder, at a path, or that match a pattern."""
    from fnmatch import fnmatch

    from pyarrow import fs

    parts = root.split("/")
    fixed = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts))
    if fixed < len(parts):
        found = system.get_file_info(fs.FileSelector("/".join(parts[:fixed]) or "/", recursive=True))
        yield from ((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch(x.path, root))
        return
    at = system.get_file_info(root)
    if at.type == fs.FileType.File:
        yield root, at.size
        return
    manifest = f"{root}/{MANIFEST}"
    if system.get_file_info(manifest).type == fs.FileType.File:
        with system.open_input_stream(manifest) as f:
            yield from ((f"{root}/{name}", n) for name, n in json.loads(f.read()))
        return
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    yield from ((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))


class WarcDataSource(DataSource):
    """format("warc"): options path (a file, a folder or a pattern), roll (bytes of a written file) and split (bytes of a read
    partition). Payloads are bodies of HTTP messages, or else the record's block; revisits have none."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options["path"], int(self.options.get("split", 32 << 20)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("roll", 32 << 20)))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records for `pages` (page_id, url, payload): payloads of `least` bytes that occur again become revisits of the page with
    the largest id. Rows that share that id are all responses; so is a group without any id. The payload of a revisit is dropped.
    """
    p = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    kept = stage(p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null").select("digest", "winner"), "warc-winners")
    p = p.join(kept, "digest", "left")
    again = F.col("winner").isNotNull() & (F.col("size") >= least) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("winner")))
    return p.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("winner").cast("string"), F.lit(">"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (columns of SCHEMA) as archives. Null headers are left out; an empty table writes an empty manifest."""
    register(records.sparkSession)
    small_batches(records.sparkSession)
    records.select(*HEADERS, "payload").write.format("warc").mode("append").option("path", path).save()


def read_warc(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives under path; with `columns` that lack payload, payloads are not inflated."""
    register(spark)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("path", path).load()


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """A WARC record for each row of `pages`, written, then read back. Null html is an empty payload."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = new_path(spark, "warc")
    write_warc(roles(pages), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    full = read_warc(spark, path).where(F.col("record_type") == "response").select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    full = stage(full, "warc-responses")
    known = full.where("page_id is not null and payload_bytes >= 1000").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = read_warc(spark, path, [*HEADERS]).where(F.col("record_type") == "revisit").select(page("record_id").alias("again_id"), page("refers_to").alias("page_id"), F.substring("payload_digest", 6, 40).alias("payload_digest"))
    again = again.join(known, ["page_id", "payload_digest"], "left").select(F.col("again_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to"))
    return full.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)
