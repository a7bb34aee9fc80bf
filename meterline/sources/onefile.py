"""One text file written by many tasks: parts first, then header, separators and footer as they are put together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at a time.
BLOCK = 8 << 20


def file_system(path: str):
    """The file system of a path or URI, and the path in it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class OneFileWriter(DataSourceArrowWriter):
    """Tasks write their rows, joined by the separator, under names of their own; a task that is run again writes another name, and
    only committed names are put together. The file appears under its name once it is whole."""

    def __init__(self, path: str, header: str, separator: str, footer: str):
        self.path, self.header, self.separator, self.footer = path, header, separator, footer
        self.run = uuid.uuid4().hex

    def folder(self, root: str) -> str:
        return f"{root}.parts-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, root = file_system(self.path)
        system.create_dir(self.folder(root), recursive=True)
        name, rows, joint = f"{self.folder(root)}/{uuid.uuid4().hex}", 0, self.separator.encode()
        with system.open_output_stream(name) as f:
            for b in batches:
                values = [v.encode() for v in b.column(0).to_pylist() if v is not None]
                if values:
                    f.write((joint if rows else b"") + joint.join(values))
                    rows += len(values)
        return Part(TaskContext.get().partitionId(), name, rows)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        system.create_dir(self.folder(root), recursive=True)
        whole, first = f"{self.folder(root)}/whole", True
        with system.open_output_stream(whole) as f:
            f.write(self.header.encode())
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                if not first:
                    f.write(self.separator.encode())
                first = False
                with system.open_input_stream(m.name) as part:
                    while block := part.read(BLOCK):
                        f.write(block)
            f.write(self.footer.encode())
        system.move(whole, root)
        system.delete_dir(self.folder(root))

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(self.folder(root)).type == fs.FileType.Directory:
            system.delete_dir(self.folder(root))


class OneFileDataSource(DataSource):
    """format("one_file"): options path, header, separator and footer, each as a JSON string; the rows' only column is text."""

    @classmethod
    def name(cls):
        return "one_file"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("one_file takes rows of one text column")
        return OneFileWriter(self.options["path"], *(json.loads(self.options.get(k, '""')) for k in ("header", "separator", "footer")))


def write_one_file(rows: DataFrame, path: str, header: str = "", separator: str = "\n", footer: str = "\n") -> None:
    """The rows (one text column) as one file, replacing what is there; null rows are left out, without rows it holds header and
    footer. The order is that of the partitions, so sort rows that need one."""
    rows.sparkSession.dataSource.register(OneFileDataSource)
    w = rows.write.format("one_file").mode("overwrite")
    for k, v in {"header": header, "separator": separator, "footer": footer}.items():
        w = w.option(k, json.dumps(v))
    w.option("path", path).save()
