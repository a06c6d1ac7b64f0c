"""Observation files and edge lists as data sources of the session: ``spark.read.format("observations")``.

After ``register(spark)`` a folder of CSV parts or of edge lists is read in partitions of whole lines and
written in parts that appear only when all tasks have ended well. Paths are those that pyarrow's file
systems open: local ones, hdfs, s3 and the like.

    wide.write.format("observations").mode("append").save(path)
    spark.read.format("observations").option("n", 6).load(path)
    tree.write.format("edge_list").mode("append").save(path)
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that one partition reads, about.
SPLIT = 64 << 20
#: Where parts lie until the write is committed; readers pass over such names.
PENDING = "_pending-"
PAIR = re.compile(rb"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


@dataclass
class Lines(InputPartition):
    """Lines of a file that begin in start..end."""

    path: str
    start: int
    end: int


class PartReader(DataSourceReader):
    """Files of a folder, each in splits of whole lines."""

    def __init__(self, path: str, schema: pa.Schema, split: int = SPLIT):
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[Lines]:
        system, path = opened(self.path)
        files = system.get_file_info(fs.FileSelector(path))
        own = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        found = [Lines(f.path, a, min(a + self.split, f.size)) for f in own for a in range(0, f.size, self.split)]
        return found or [Lines("", 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(max(partition.start - 1, 0))
            data = f.read(partition.end - f.tell())
            if partition.start:  # the line that the byte before belongs to is another split's
                data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
            if data and not data.endswith(b"\n"):
                rest = [data]
                while part := f.read(1 << 16):
                    at = part.find(b"\n")
                    rest.append(part if at < 0 else part[: at + 1])
                    if at >= 0:
                        break
                data = b"".join(rest)
        yield from self.batches(data, partition.start == 0)

    def batches(self, data: bytes, first: bool) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class ObservationReader(PartReader):
    def batches(self, data: bytes, first: bool) -> Iterator[pa.RecordBatch]:
        if first:  # the header
            data = data[data.find(b"\n") + 1 :]
        if data:
            names = self.schema.names
            table = csv.read_csv(io.BytesIO(data), read_options=csv.ReadOptions(column_names=names), convert_options=csv.ConvertOptions(column_types={f.name: f.type for f in self.schema}))
            t = pa.array(table["t"].to_numpy() + 1, pa.int64())
            yield from table.set_column(0, self.schema.field(0), t).to_batches()


class EdgeReader(PartReader):
    def batches(self, data: bytes, first: bool) -> Iterator[pa.RecordBatch]:
        found = PAIR.findall(data)
        yield pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int32()) for k in (0, 1)], schema=self.schema)


@dataclass
class Part(WriterCommitMessage):
    """The name of a part that a task has written, none where it had no rows."""

    name: str | None


class PartWriter(DataSourceArrowWriter):
    """A part for each task in a pending folder; commit moves all into place, abort removes all."""

    def __init__(self, path: str, overwrite: bool, end: str):
        self.path, self.overwrite, self.end = path, overwrite, end
        self.pending = f"{PENDING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, path = opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}{self.end}", None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        system.create_dir(f"{path}/{self.pending}")
                        out = system.open_output_stream(f"{path}/{self.pending}/{name}")
                        self.begin(out, batch.schema)
                    self.put(out, batch)
        finally:
            if out is not None:
                self.finish(out)
                out.close()
        return Part(name if out is not None else None)

    def commit(self, messages: list[Part | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m and m.name:
                system.move(f"{path}/{self.pending}/{m.name}", f"{path}/{m.name}")
        self.clear(system, path)

    def abort(self, messages: list[Part | None]) -> None:
        self.clear(*opened(self.path))

    def clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.pending}")

    def begin(self, out: pa.NativeFile, schema: pa.Schema) -> None: ...

    def put(self, out: pa.NativeFile, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def finish(self, out: pa.NativeFile) -> None: ...


class ObservationWriter(PartWriter):
    """CSV with a row index of t - 1 and a header, as read_observations takes it."""

    def begin(self, out: pa.NativeFile, schema: pa.Schema) -> None:
        out.write((",".join(["", *(n[1:] for n in schema.names[1:])]) + "\n").encode())

    def put(self, out: pa.NativeFile, batch: pa.RecordBatch) -> None:
        index = pa.array(batch.column(0).to_numpy() - 1, pa.int64())
        csv.write_csv(pa.RecordBatch.from_arrays([index, *batch.columns[1:]], batch.schema.names), out, csv.WriteOptions(include_header=False))


class EdgeWriter(PartWriter):
    """Lists of pairs, a line for each batch of edges."""

    def put(self, out: pa.NativeFile, batch: pa.RecordBatch) -> None:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        out.write(("[" + ", ".join(f"({i}, {j})" for i, j in pairs) + "]\n").encode())


class Observations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return ", ".join(["t long", *(f"v{i} int" for i in range(int(self.options["n"])))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ObservationReader(self.options["path"], pa.schema([pa.field("t", pa.int64()), *(pa.field(f.name, pa.int32()) for f in schema.fields[1:])]), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ObservationWriter(self.options["path"], overwrite, ".csv")


class EdgeLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edge_list"

    def schema(self) -> str:
        return "i int, j int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EdgeReader(self.options["path"], pa.schema([pa.field("i", pa.int32()), pa.field("j", pa.int32())]), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return EdgeWriter(self.options["path"], overwrite, ".txt")


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (Observations, EdgeLists):
        spark.dataSource.register(source)
