"""Folders of .npz files, one a series, as tables of arrays."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from panelith.shipping import ship

SCHEMA = "series_id string, name string, dtype string, shape array<int>, data binary"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self._path = path

    def partitions(self) -> list[InputPartition]:
        system, root = _place(self._path)
        found = system.get_file_info(fs.FileSelector(root))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".npz")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _place(self._path)
        with system.open_input_file(partition.path) as f, np.load(f, allow_pickle=False) as arrays:
            series = unquote(partition.path.rsplit("/", 1)[-1][: -len(".npz")])
            for name in arrays.files:
                a = arrays[name]
                yield series, name, a.dtype.str, list(a.shape), a.tobytes()


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self._path = path
        system, root = _place(path)
        system.create_dir(root, recursive=True)
        if overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.path.endswith(".npz"):
                    system.delete_file(f.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """A file for each run of rows of one series; each appears whole, under its name, so a task that runs again writes the same."""
        system, root = _place(self._path)
        now, arrays, files = None, {}, 0

        def flush() -> None:
            out = io.BytesIO()
            np.savez_compressed(out, **arrays)
            temporary = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(out.getvalue())
            system.move(temporary, f"{root}/{quote(now, safe='')}.npz")

        for r in iterator:
            if r.series_id is None or r.name is None:
                raise ValueError("arrays need a series and a name")
            if now is not None and r.series_id != now:
                flush()
                files, arrays = files + 1, {}
            now = r.series_id
            arrays[r.name] = np.frombuffer(bytes(r.data), np.dtype(r.dtype)).reshape(r.shape)
        if now is not None:
            flush()
            files += 1
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


class Npz(DataSource):
    """spark.read.format('npz').load(folder): (series_id, name, dtype, shape, data), a row for each array of each file, a task for each file; data in C order, bit by bit."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Npz)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("npz").load(path)


def write(arrays: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (series_id, name, dtype, shape, data), one file a series. The rows of a series go to one task and come together."""
    register(arrays.sparkSession)
    arrays.select("series_id", "name", "dtype", F.col("shape").cast("array<int>").alias("shape"), "data").repartition("series_id").sortWithinPartitions("series_id", "name").write.format("npz").mode(mode).save(path)


def panel(arrays: DataFrame, name: str = "y") -> DataFrame:
    """(series_id, i, y): the values of each series' one-dimensional array of a name, null where NaN."""
    ship(arrays.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for series, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                y = np.frombuffer(data, np.dtype(kind)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([series] * len(y), pa.string()), pa.array(np.arange(len(y))), pa.array(y, pa.float64(), from_pandas=True)], names=["series_id", "i", "y"])

    return arrays.filter(F.col("name") == name).select("series_id", "dtype", "data").mapInArrow(run, "series_id string, i long, y double")


def packed(rows: DataFrame, name: str = "y", series: str = "series_id", order: str = "i", y: str = "y") -> DataFrame:
    """(series_id, name, dtype, shape, data) of a panel's rows: each series one array of doubles, NaN for null, in order. A series meets in one row, as in its file."""
    ship(rows.sparkSession)
    lists = rows.groupBy(F.col(series).cast("string").alias("series_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.coalesce(F.col(y).cast("double"), F.lit(float("nan"))).alias("y")))).alias("v")).select("series_id", F.col("v.y").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [np.array(v, "<f8") for v in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([name] * len(arrays)), pa.array(["<f8"] * len(arrays)), pa.array([[len(a)] for a in arrays], pa.list_(pa.int32())), pa.array([a.tobytes() for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["series_id", "name", "dtype", "shape", "data"])

    return lists.mapInArrow(run, SCHEMA)
