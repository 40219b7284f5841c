"""Arrow files and streams as a data source of its own: a task reads some record batches, not a file.

Files of both Arrow formats are sequences of messages with their lengths in front. Planning reads these lengths only (not the batches), groups record batches
into ranges of `bytes` bytes, and gives each range to a task with the schema and the dictionaries before it. As a stream, the folder's files
come in order of their names; an offset is a file's name and how far it has been read, so that the last file may still grow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tessera.shipping import ship
from tessera.sources.ranges import cut, file_system

FORMAT = "tessera_arrow"
RANGE_BYTES = 64 << 20
SCHEMA, DICTIONARY, BATCH = 1, 2, 3


def _header(meta: bytes) -> tuple[int, int]:
    """Kind and length of the body of a message, from its FlatBuffers table (fields 1 and 3)."""
    table = struct.unpack_from("<I", meta)[0]
    fields = table - struct.unpack_from("<i", meta, table)[0]
    size = struct.unpack_from("<H", meta, fields)[0]

    def at(field: int) -> int:
        slot = 4 + 2 * field
        return struct.unpack_from("<H", meta, fields + slot)[0] if slot < size else 0

    kind, body = at(1), at(3)
    return meta[table + kind] if kind else 0, struct.unpack_from("<q", meta, table + body)[0] if body else 0


def messages(path: str, start: int = 0) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of a file's whole messages from a message's start on; a message that is still being written ends them."""
    at, name = file_system(path)
    with at.open_input_file(name) as f:
        size = f.size()
        pos = start or (8 if f.read_at(min(6, size), 0) == b"ARROW1" else 0)
        while pos + 8 <= size:
            first, second = struct.unpack("<ii", f.read_at(8, pos))
            begin, meta = (pos + 8, second) if first == -1 else (pos + 4, first)
            if meta <= 0 or begin + meta > size:
                return
            kind, body = _header(f.read_at(meta, begin))
            end = begin + meta + body
            if end > size:
                return
            yield kind, pos, end
            pos = end


@dataclass
class Range(InputPartition):
    """Record batches of a file from start to end, and the messages that they need: schema and dictionaries."""

    path: str
    needs: list[tuple[int, int]]
    start: int
    end: int


def ranges(path: str, most: int = RANGE_BYTES, begin: int = 0, stop: int | None = None) -> list[Range]:
    """Ranges of a file's record batches, each of about `most` bytes at least; those that begin in [begin, stop) only."""
    needs: list[tuple[int, int]] = []
    out: list[Range] = []
    for kind, lo, hi in messages(path):
        if kind in (SCHEMA, DICTIONARY):
            needs = [*needs, (lo, hi)]
        elif kind == BATCH and lo >= begin and (stop is None or lo < stop):
            last = out[-1] if out else None
            if last and last.end == lo and last.end - last.start < most and len(last.needs) == len(needs):
                last.end = hi
            else:
                out.append(Range(path, needs, lo, hi))
    return out


def _plain(kind: pa.DataType) -> pa.DataType:
    """Without dictionaries."""
    return kind.value_type if pa.types.is_dictionary(kind) else kind


def schema_of(path: str) -> StructType:
    for kind, lo, hi in messages(path):
        if kind == SCHEMA:
            found = pa.ipc.read_schema(pa.py_buffer(cut(path, lo, hi)))
            return from_arrow_schema(pa.schema([f.with_type(_plain(f.type)) for f in found]))
    raise ValueError(f"no Arrow schema in {path}")


def batches(part: Range, schema: StructType) -> Iterator[pa.RecordBatch]:
    data = b"".join(cut(part.path, lo, hi) for lo, hi in (*part.needs, (part.start, part.end)))
    want = to_arrow_schema(schema)
    for b in pa.ipc.open_stream(pa.py_buffer(data)):
        columns = [b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in want]  # a file may lack a column
        yield pa.RecordBatch.from_arrays(columns, schema=want)


def _files(path: str) -> list[str]:
    """Files of a comma-separated list of files and folders, in order of their names in each folder."""
    from pyarrow.fs import FileSelector, FileType

    out = []
    for p in (x.strip() for x in path.split(",")):
        at, name = file_system(p)
        if at.get_file_info(name).type == FileType.Directory:
            found = sorted(i.path for i in at.get_file_info(FileSelector(name)) if i.type == FileType.File and not i.base_name.startswith((".", "_")))
            out += [f"{p.rstrip('/')}/{f.rsplit('/', 1)[-1]}" for f in found]
        else:
            out.append(p)
    return out


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no files in {self.options['path']}")
        return schema_of(files[0])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 (Spark's name)
        return ArrowStream(self.options, schema)


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.most, self.schema = options["path"], int(options.get("bytes", RANGE_BYTES)), schema

    def partitions(self) -> list[Range]:
        return [r for f in _files(self.path) for r in ranges(f, self.most)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.schema) if isinstance(partition, Range) else iter([])


class ArrowStream(ArrowReader, DataSourceStreamReader):
    """Offsets {"file", "at"}: all files before this one, and this one up to here, have been read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        if not files:
            return self.initialOffset()
        return {"file": files[-1], "at": max((hi for *_, hi in messages(files[-1])), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for f in _files(self.path):
            if start["file"] <= f <= end["file"]:
                out += ranges(f, self.most, start["at"] if f == start["file"] else 0, end["at"] if f == end["file"] else None)
        return out

    def commit(self, end: dict) -> None:
        pass


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArrowSource)


def read_arrow(spark: SparkSession, paths: list[str], schema: StructType | None = None, most: int = RANGE_BYTES) -> DataFrame:
    """Arrow files and folders of them; without a schema, that of the first file counts, and what other files lack is null."""
    _registered(spark)
    reader = spark.read.format(FORMAT).option("bytes", most)
    return (reader if schema is None else reader.schema(schema)).load(",".join(paths))


def stream_arrow(spark: SparkSession, path: str, schema: StructType | None = None, most: int = RANGE_BYTES) -> DataFrame:
    _registered(spark)
    reader = spark.readStream.format(FORMAT).option("bytes", most)
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """Writes each partition as one Arrow file of the folder, in its task, and gives (file, rows). A file is renamed when it is whole, so that a task may run again."""
    ship(df.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyspark import TaskContext

        at, top = file_system(path)
        at.create_dir(top)
        name, rows, writer = f"part-{TaskContext.get().partitionId():05d}.arrow", 0, None
        own = f"{top}/.{name}.{uuid4().hex}"
        with at.open_output_stream(own) as sink:
            for b in found:
                writer = writer or pa.ipc.new_stream(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
            if writer:
                writer.close()
        if rows:
            at.move(own, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]})
        else:
            at.delete_file(own)

    counts = df.mapInArrow(run, "file string, rows long").toArrow()  # a row for each file
    return df.sparkSession.createDataFrame(counts)
