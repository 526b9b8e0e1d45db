"""Binary formats, read by Spark's binaryFile source: IDX images and labels, volumes with short headers.

A file is a row, so that a task decodes it and yields its rows some at a time; many files are many tasks. The source takes files of up to 2 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

IDX_IMAGES, IDX_LABELS = 2051, 2049


def big_endian(data: bytes, at: int) -> int:
    return struct.unpack_from(">i", data, at)[0]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_idx_images(spark: SparkSession, path: str) -> DataFrame:
    """path, id, features of the files at a path."""
    return idx_images(_files(spark, path))


def idx_images(files: DataFrame) -> DataFrame:
    """(path, content) -> path, id (within the file), features array<float>: pixels over 255. Another magic number, or a file shorter than its header says, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if big_endian(data, 0) != IDX_IMAGES:
                    raise ValueError("not an IDX image file")
                n, size = big_endian(data, 4), big_endian(data, 8) * big_endian(data, 12)
                px = np.frombuffer(data, dtype=np.uint8, offset=16, count=n * size).reshape(n, size)
                for at in range(0, n, 1024):
                    part = px[at : at + 1024].astype(np.float32) / np.float32(255)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), lists], names=["path", "id", "features"])

    return files.select("path", "content").mapInArrow(run, "path string, id long, features array<float>")


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, id, label of the files at a path."""
    return idx_labels(_files(spark, path))


def idx_labels(files: DataFrame) -> DataFrame:
    """(path, content) -> path, id (within the file), label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if big_endian(data, 0) != IDX_LABELS:
                    raise ValueError("not an IDX label file")
                labels = np.frombuffer(data, dtype=np.uint8, offset=8, count=big_endian(data, 4))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(labels), pa.string()), pa.array(np.arange(len(labels))), pa.array(labels.astype(np.int32))], names=["path", "id", "label"])

    return files.select("path", "content").mapInArrow(run, "path string, id long, label int")


def fld_header(data: bytes) -> tuple[tuple[int, int, int], int, int]:
    """Sides, bytes a voxel and the payload's place of a .fld file: key=value lines up to the two form feeds before the voxels."""
    end = data.index(b"\f")
    found = {}
    for line in data[:end].decode("latin-1").splitlines():
        line = line.split("#")[0]
        if "=" in line:
            key, value = line.split("=", 1)
            found[key.strip().lower()] = value.strip().lower()
    kind = found.get("data", "byte")
    if kind not in ("byte", "short"):
        raise ValueError(f"voxels of kind {kind}")
    return (int(found["dim1"]), int(found["dim2"]), int(found["dim3"])), 1 if kind == "byte" else 2, end + 2


def dat_header(data: bytes) -> tuple[tuple[int, int, int], int, int]:
    """Three 16-bit sides, then 16-bit voxels."""
    return struct.unpack_from("<3H", data), 2, 6


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, val of a .fld or .dat file, x fastest. Another ending is an error."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending not in ("fld", "dat"):
        raise ValueError(f"no volume format .{ending}")
    return volume(_files(spark, path), ending).drop("path")


def volume(files: DataFrame, ending: str) -> DataFrame:
    """(path, content) -> path, x, y, z, val of volumes in the format of an ending, a plane at a time."""
    header = {"fld": fld_header, "dat": dat_header}[ending]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                (nx, ny, nz), width, at = header(data)
                flat = np.frombuffer(data, dtype=np.uint8 if width == 1 else "<u2", offset=at, count=nx * ny * nz)
                y, x = np.divmod(np.arange(nx * ny, dtype=np.int32), nx)
                for z in range(nz):
                    val = flat[z * nx * ny : (z + 1) * nx * ny].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(val), pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(np.full(nx * ny, z), pa.int32()), pa.array(val)], names=["path", "x", "y", "z", "val"])

    return files.select("path", "content").mapInArrow(run, "path string, x int, y int, z int, val double")
