"""Array files (.npy) as a Spark data source, `npy`: two-dimensional arrays of numbers, read in ranges of rows.

    spark.dataSource.register(npy.ArrayFiles)
    spark.read.format("npy").option("columns", "0,3-5").load(folder)      # path, row, values
    df.select("values").write.format("npy").mode("append").save(folder)   # a file for each partition

Options for reading: `columns` (places and ranges; only their bytes are read, where the file is in column order, and only
they leave the reader), `rows` (rows of a range, 65,536).  Paths are those of pyarrow's file systems, so folders that all
executors reach.  Headers are parsed once, on the driver; files that are no arrays, or of another kind, are an error that
names them.  Writing is in two steps: tasks write under names of their own and the commit renames them, so that a task that
runs twice leaves one file."""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"\x93NUMPY"
ROWS, BATCH = 65_536, 4096


def header(read) -> tuple[np.dtype, bool, tuple, int]:
    """(type, column order, shape, place of the data), by `read(place, size)`."""
    first = read(0, 12)
    if first[:6] != MAGIC or first[6] not in (1, 2, 3):
        raise ValueError("no array file")
    wide = first[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", first, 8)[0]
    at = 12 if wide else 10
    told = ast.literal_eval(read(at, size).decode("utf-8" if first[6] == 3 else "latin1"))
    kind = np.dtype(told["descr"])
    if kind.hasobject or kind.kind not in "iufb":
        raise ValueError(f"an array of {told['descr']}")
    return kind, told["fortran_order"], tuple(told["shape"]), at + size


def head_bytes(kind: np.dtype, shape: tuple) -> bytes:
    """The header of a file in row order, its data at a multiple of 64."""
    told = f"{{'descr': {kind.str!r}, 'fortran_order': False, 'shape': {shape!r}, }}"
    told += " " * (-(len(told) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(told)) + told.encode("latin1")


def places(columns: str | None, width: int) -> list[int]:
    if not columns:
        return list(range(width))
    out = []
    for part in columns.split(","):
        low, _, high = part.strip().partition("-")
        out += range(int(low), int(high or low) + 1)
    if any(not 0 <= c < width for c in out):
        raise ValueError(f"columns {columns} of {width}")
    return out


@dataclass
class Range(InputPartition):
    path: str
    first: int
    stop: int
    shape: tuple
    kind: str
    by_column: bool
    data: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.columns, self.rows = options["path"], options.get("columns"), int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        files, base = fs.FileSystem.from_uri(self.folder)
        info = files.get_file_info(base)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in found if f.is_file and f.base_name.endswith(".npy")), key=lambda f: f.path):
            with files.open_input_file(f.path) as handle:
                try:
                    kind, by_column, shape, data = header(lambda at, n: handle.read_at(n, at))  # noqa: B023
                except (ValueError, SyntaxError, KeyError, IndexError, struct.error, TypeError) as e:
                    raise ValueError(f"{f.path}: {e}") from e
            if len(shape) != 2:
                raise ValueError(f"{f.path}: {len(shape)} dimensions")
            places(self.columns, shape[1])
            out += [Range(f.path, a, min(a + self.rows, shape[0]), shape, kind.str, by_column, data) for a in range(0, shape[0], self.rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.folder)
        kind, (n, width), wanted = np.dtype(part.kind), part.shape, places(self.columns, part.shape[1])
        with files.open_input_file(part.path) as handle:
            for a in range(part.first, part.stop, BATCH):
                b = min(a + BATCH, part.stop)
                if part.by_column:
                    columns = [np.frombuffer(handle.read_at((b - a) * kind.itemsize, part.data + (c * n + a) * kind.itemsize), kind) for c in wanted]
                    rows = np.stack(columns, 1) if columns else np.zeros((b - a, 0))
                else:
                    rows = np.frombuffer(handle.read_at((b - a) * width * kind.itemsize, part.data + a * width * kind.itemsize), kind).reshape(b - a, width)[:, wanted]
                flat = pa.array(rows.astype(float).ravel())
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * len(wanted) + 1, len(wanted) or 1)[: b - a + 1] if wanted else np.zeros(b - a + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * (b - a)), pa.array(np.arange(a, b)), values], names=["path", "row", "values"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ArrayWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.kind, self.overwrite = options["path"], options.get("dtype", "<f8"), overwrite

    def write(self, rows: Iterator) -> Written:
        files, base = fs.FileSystem.from_uri(self.folder)
        files.create_dir(base, recursive=True)
        values = [r["values"] for r in rows]  # a partition's rows: the header tells their number
        if not values:
            return Written(None)
        array = np.asarray(values, np.dtype(self.kind))
        if array.ndim != 2:
            raise ValueError("values of different lengths")
        path = f"{base}/.part-{uuid.uuid4().hex}"
        with files.open_output_stream(path) as out:
            out.write(head_bytes(array.dtype, array.shape))
            out.write(array.tobytes())
        return Written(path)

    def commit(self, messages: list) -> None:
        files, base = fs.FileSystem.from_uri(self.folder)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".npy"):
                    files.delete_file(f.path)
        tag = uuid.uuid4().hex[:8]
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            files.move(m.path, f"{base}/part-{i:05d}-{tag}.npy")

    def abort(self, messages: list) -> None:
        files, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None and m.path:
                files.delete_file(m.path)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row bigint, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArrayWriter(self.options, overwrite)
