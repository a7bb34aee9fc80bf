"""ESRI shapefiles as a PySpark data source: partitions from the record index, a bounding box pushed down, attributes on demand."""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .onefile import file_system

# Fixed values of the format: the file code and version, the kinds of shapes, and where a header ends.
CODE, VERSION, HEADER = 9994, 1000, 100
NOTHING, POINT, LINE, POLYGON = 0, 1, 3, 5
_XY = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
SHAPE = [StructField("record", LongType()), StructField("kind", LongType()), *[StructField(c, DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")], StructField("rings", ArrayType(ArrayType(_XY)))]
BOX = ("xmin", "ymin", "xmax", "ymax")


def table_of(path: str) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, type, width, decimals) of the attributes, rows, bytes of the header and of a row, from the .dbf file's header."""
    with opened(path, ".dbf") as f:
        rows, head, width = struct.unpack("<IHH", f.read(12)[4:12])
        f.seek(32)
        raw = f.read(head - 32)
    fields = []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        name, kind, size, digits = struct.unpack("<11sc4xBB14x", raw[at : at + 32])
        fields.append((name.split(b"\0")[0].decode("ascii", "replace"), kind.decode(), size, digits))
    return fields, rows, head, width


@contextmanager
def opened(path: str, ending: str):
    """The file of that ending: beside the .shp at `path`, or in the .zip at `path`."""
    system, at = file_system(path)
    with ExitStack() as stack:
        if at.lower().endswith(".zip"):
            archive = stack.enter_context(zipfile.ZipFile(stack.enter_context(system.open_input_file(at))))
            yield stack.enter_context(archive.open(next(n for n in archive.namelist() if n.lower().endswith(ending))))
        else:
            yield stack.enter_context(system.open_input_file(at[:-4] + ending))


def shapefiles(path: str) -> list[str]:
    """The file itself, or the .shp and .zip files directly in a folder."""
    from pyarrow import fs

    system, at = file_system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(at)) if x.extension.lower() in ("shp", "zip"))


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = schema, path, split
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters):
        """Comparisons of a shape's box are tested on the record's first bytes, before its points are read."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.bounds.append((f.attribute[0], signs[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self):
        """Ranges of records of about `split` bytes, from the lengths in the index."""
        out = []
        for path in shapefiles(self.path):
            with opened(path, ".shx") as f:
                f.seek(HEADER)
                first = at = held = 0
                while block := f.read(8 << 17):
                    for (size,) in struct.iter_unpack(">4xI", block):
                        held += 2 * size
                        at += 1
                        if held >= self.split:
                            out.append(Records(path, first, at))
                            first, held = at, 0
                if at > first:
                    out.append(Records(path, first, at))
        return out or [Records("", 0, 0)]

    def kept(self, box: tuple[float, ...] | None) -> bool:
        tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return not self.bounds or (box is not None and all(tests[s](box[BOX.index(c)], v) for c, s, v in self.bounds))

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        arrow = pa.schema([(f.name, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))) if f.name == "rings" else pa.int64() if isinstance(f.dataType, LongType) else pa.float64() if isinstance(f.dataType, DoubleType) else pa.string()) for f in self.schema.fields])
        if part.last == part.first:
            return
        fields, _, head, width = table_of(part.path)
        places, at = {}, 1
        for name, _, size, _ in fields:
            places[name], at = (at, at + size), at + size
        wanted = {n: places[n] for n in names if n in places}
        with opened(part.path, ".shx") as x, opened(part.path, ".shp") as s, ExitStack() as stack:
            d = stack.enter_context(opened(part.path, ".dbf")) if wanted else None
            x.seek(HEADER + 8 * part.first)
            index = list(struct.iter_unpack(">II", x.read(8 * (part.last - part.first))))
            rows: list[dict] = []
            held = 0
            for i, (offset, size) in enumerate(index):
                s.seek(2 * offset + 8)
                body = s.read(2 * size)
                kind, box = self.box(body)
                if not self.kept(box):
                    continue
                row = {"record": part.first + i, "kind": kind, **dict(zip(BOX, box or (None,) * 4))}
                if "rings" in names:
                    row["rings"] = self.rings(kind, body)
                if d is not None:
                    d.seek(head + width * (part.first + i))
                    line = d.read(width)
                    for n, (a, b) in wanted.items():
                        value = line[a:b].decode("utf-8", "replace").strip(" \0")
                        kind_of = arrow.field(n).type
                        row[n] = (value or None) if kind_of == pa.string() else int(value) if value and kind_of == pa.int64() else float(value) if value else None
                rows.append(row)
                held += len(body) + 100
                if held > 2 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    @staticmethod
    def box(body: bytes) -> tuple[int, tuple[float, ...] | None]:
        (kind,) = struct.unpack_from("<i", body)
        if kind == NOTHING:
            return kind, None
        if kind % 10 == POINT:
            x, y = struct.unpack_from("<2d", body, 4)
            return kind, (x, y, x, y)
        return kind, struct.unpack_from("<4d", body, 4)

    @staticmethod
    def rings(kind: int, body: bytes) -> list[list[dict]] | None:
        """The parts of a line or polygon, without the closing corner of a polygon's ring; a point is one part of one corner."""
        if kind == NOTHING:
            return None
        if kind % 10 == POINT:
            x, y = struct.unpack_from("<2d", body, 4)
            return [[{"x": x, "y": y}]]
        if kind % 10 not in (LINE, POLYGON):
            raise ValueError(f"shapes of kind {kind} aren't read")
        parts, points = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        at = [{"x": x, "y": y} for x, y in struct.iter_unpack("<2d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])]
        out = [at[a:b] for a, b in zip(starts, starts[1:])]
        return [r[:-1] if kind % 10 == POLYGON and len(r) > 1 and r[0] == r[-1] else r for r in out]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class ShapefileWriter(DataSourceArrowWriter):
    """A shapefile for each task, in a folder: written under a hidden name, renamed when the job commits."""

    def __init__(self, schema: StructType, path: str):
        self.path, self.names = path, [f.name for f in schema.fields]
        self.attributes = [f.name for f in schema.fields if f.name not in {s.name for s in SHAPE}]
        self.widths = {f.name: (b"N", 20, 0) if f.dataType.simpleString() in ("int", "bigint") else (b"F", 25, 15) if f.dataType.simpleString() in ("double", "float") else (b"C", 254, 0) for f in schema.fields}

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        low, high, rows, offset = [float("inf")] * 2, [float("-inf")] * 2, 0, HEADER
        with ExitStack() as stack:
            shp, shx, dbf = (stack.enter_context(system.open_output_stream(f"{root}/_{name}.{e}.body")) for e in ("shp", "shx", "dbf"))
            for b in batches:
                for row in b.to_pylist():
                    body, box = self.shape(row.get("rings"))
                    if box:
                        low, high = [min(low[0], box[0]), min(low[1], box[1])], [max(high[0], box[2]), max(high[1], box[3])]
                    rows += 1
                    shp.write(struct.pack(">II", rows, len(body) // 2) + body)
                    shx.write(struct.pack(">II", offset // 2, len(body) // 2))
                    offset += 8 + len(body)
                    dbf.write(b" " + b"".join(self.text(row[c], *self.widths[c]) for c in self.attributes))
        if not rows:
            return Written(())
        box = (*low, *high) if low[0] <= high[0] else (0.0,) * 4
        heads = {e: struct.pack(">I20xI", CODE, size // 2) + struct.pack("<II4d32x", VERSION, POLYGON, *box) for e, size in (("shp", offset), ("shx", HEADER + 8 * rows))}
        fields = b"".join(struct.pack("<11sc4xBB14x", c.encode("ascii", "replace")[:10], *self.widths[c]) for c in self.attributes)
        heads["dbf"] = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, rows, 33 + len(fields), 1 + sum(self.widths[c][1] for c in self.attributes)) + fields + b"\r"
        for e, head in heads.items():
            with system.open_output_stream(f"{root}/_{name}.{e}") as out, system.open_input_stream(f"{root}/_{name}.{e}.body") as body:
                out.write(head)
                while block := body.read(8 << 20):
                    out.write(block)
            system.delete_file(f"{root}/_{name}.{e}.body")
        return Written((name,))

    @staticmethod
    def shape(rings) -> tuple[bytes, tuple[float, ...] | None]:
        rings = [r for r in rings or [] if r]
        if not rings:
            return struct.pack("<i", NOTHING), None
        closed = [[(p["x"], p["y"]) for p in [*r, r[0]]] for r in rings]
        flat = [p for r in closed for p in r]
        box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
        starts, at = [], 0
        for r in closed:
            starts.append(at)
            at += len(r)
        return struct.pack(f"<i4d2i{len(closed)}i", POLYGON, *box, len(closed), at, *starts) + b"".join(struct.pack("<2d", *p) for p in flat), box

    @staticmethod
    def text(value, kind: bytes, width: int, digits: int) -> bytes:
        if value is None:
            return b" " * width
        if kind == b"C":
            raw = str(value).encode()
            if len(raw) > width:
                raise ValueError(f"a text of {len(raw)} bytes doesn't fit an attribute of {width}")
            return raw.ljust(width)
        return (repr(float(value)) if digits else str(value)).encode().rjust(width)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else ():
                for e in ("dbf", "shx", "shp"):
                    system.move(f"{root}/_{name}.{e}", f"{root}/{name}.{e}")

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else ():
                for e in ("dbf", "shx", "shp"):
                    system.delete_file(f"{root}/_{name}.{e}")


class ShapefileDataSource(DataSource):
    """format("shapefile"): option path (a .shp or .zip file, or a folder of them) and split (bytes of a read partition). Columns: record,
    kind, xmin, ymin, xmax, ymax, rings and the attributes, texts as UTF-8. Give a schema of fewer columns to read no more."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        found = shapefiles(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no shapefile in {self.options['path']}")
        fields, *_ = table_of(found[0])
        kinds = {"N": LongType, "F": DoubleType}
        return StructType([*SHAPE, *[StructField(n, DoubleType() if k == "N" and digits else kinds.get(k, StringType)()) for n, k, _, digits in fields]])

    def reader(self, schema):
        return ShapefileReader(schema, self.options["path"], int(self.options.get("split", 32 << 20)))

    def writer(self, schema, overwrite):
        return ShapefileWriter(schema, self.options["path"])


def read_shapes(spark: SparkSession, path: str, schema: str | None = None, split: int = 32 << 20) -> DataFrame:
    """The shapes at a path; with a schema, only its columns are read. Filters on xmin, ymin, xmax and ymax reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileDataSource)
    r = spark.read.format("shapefile").option("path", path).option("split", split)
    return (r.schema(schema) if schema else r).load()


def write_shapes(shapes: DataFrame, path: str) -> None:
    """shapes (rings: polygons; other columns: attributes) as shapefiles in a folder, one for each task that has rows. Names of
    attributes are cut to 10 characters by the format; texts may have 254 bytes; nulls are blank and read back as nulls."""
    shapes.sparkSession.dataSource.register(ShapefileDataSource)
    shapes.write.format("shapefile").mode("append").option("path", path).save()
