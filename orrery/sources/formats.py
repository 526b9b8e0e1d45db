"""Spark formats of binary files, as Python data sources: idx, voxels, ndarray and blobs.

    register(spark); spark.read.format("idx").load(path); df.write.format("ndarray").option("shape", "3,4").mode("overwrite").save(path)

Readers cut a file into ranges of items at places that its header gives, so that one large file is many tasks, each of which reads its own bytes. Paths may be a file or a folder of files, in any
store that pyarrow.fs knows by its address; writers need a file system that takes writes anywhere in a file, shared by driver and executors.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .binary import IDX_IMAGES, IDX_LABELS, dat_header, fld_header

#: Bytes of items a task reads, unless the option splitBytes says otherwise, and a batch of rows.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 1 << 20
#: A text header is looked for in so many bytes.
HEADER_BYTES = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path with their sizes, in the order of names; hidden ones and those of writers are none."""
    store, place = _opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
    kept = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    prefix = path[: path.index(place)] if place in path else ""
    return sorted((prefix + f.path, f.size) for f in kept)


def _bytes(path: str, start: int, count: int) -> bytes:
    store, place = _opened(path)
    with store.open_input_file(place) as f:
        f.seek(start)
        return f.read(count)


@dataclass
class Stretch(InputPartition):
    """Items first to last (not included) of a file."""

    path: str
    first: int
    last: int


@dataclass
class Layout:
    """Where the items of a file begin, how many there are and how long one is; shape: what the header says."""

    start: int
    items: int
    width: int
    shape: tuple[int, ...]


class ItemReader(DataSourceReader):
    """Files of items of one width. A subclass says how a file is laid out and what rows items are."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def layout(self, path: str, size: int) -> Layout:
        raise NotImplementedError

    def rows(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        raise NotImplementedError

    def checked(self, path: str, size: int) -> Layout:
        found = self.layout(path, size)
        if size < found.start + found.items * found.width:
            raise ValueError(f"{path} is shorter than its header says")
        return found

    def partitions(self) -> list[Stretch]:
        made = []
        for path, size in _files(self.path):
            layout = self.checked(path, size)
            step = max(1, self.split // max(1, layout.width))
            made += [Stretch(path, k, min(k + step, layout.items)) for k in range(0, layout.items, step)]
        return made or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        layout = self.layout(partition.path, 0)
        step = max(1, BATCH_BYTES // layout.width)
        for k in range(partition.first, partition.last, step):
            n = min(step, partition.last - k)
            yield self.rows(partition.path, layout, k, _bytes(partition.path, layout.start + k * layout.width, n * layout.width))


# ---- idx -----------------------------------------------------------------------------------------------------------


class IdxReader(ItemReader):
    def layout(self, path: str, size: int) -> Layout:
        head = _bytes(path, 0, 16)
        magic, n = struct.unpack_from(">2i", head)
        if magic == IDX_IMAGES:
            high, wide = struct.unpack_from(">2i", head, 8)
            return Layout(16, n, high * wide, (high, wide))
        if magic == IDX_LABELS:
            return Layout(8, n, 1, ())
        raise ValueError(f"{path} is not an IDX file of images or labels")

    def rows(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        item = np.frombuffer(data, dtype=np.uint8)
        n = len(item) // layout.width
        if layout.shape:
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * layout.width), pa.array(item.astype(np.float32) / np.float32(255)))
        else:
            values = pa.array(item.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), values], names=["path", "id", "features" if layout.shape else "label"])


class Idx(DataSource):
    """path, id (within the file) and features (pixels over 255) or label, as the first file's kind says."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        found = _files(self.options["path"])
        images = not found or struct.unpack(">i", _bytes(found[0][0], 0, 4))[0] != IDX_LABELS
        return "path string, id long, " + ("features array<float>" if images else "label int")

    def reader(self, schema: StructType) -> IdxReader:
        return IdxReader(dict(self.options))


# ---- voxels --------------------------------------------------------------------------------------------------------


class VoxelReader(ItemReader):
    def layout(self, path: str, size: int) -> Layout:
        ending = path.lower().rsplit(".", 1)[-1]
        if ending not in ("fld", "dat"):
            raise ValueError(f"no volume format .{ending}")
        shape, width, start = fld_header(_bytes(path, 0, HEADER_BYTES)) if ending == "fld" else dat_header(_bytes(path, 0, 6))
        return Layout(start, shape[0] * shape[1] * shape[2], width, shape)

    def rows(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        val = np.frombuffer(data, dtype=np.uint8 if layout.width == 1 else "<u2").astype(np.float64)
        at = np.arange(first, first + len(val))
        nx, ny, _ = layout.shape
        place = [pa.array(v.astype(np.int32)) for v in (at % nx, at // nx % ny, at // (nx * ny))]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(val), pa.string()), *place, pa.array(val)], names=["path", "x", "y", "z", "val"])


class Voxels(DataSource):
    """path, x, y, z, val of .dat and .fld files, x fastest."""

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def schema(self) -> str:
        return "path string, x int, y int, z int, val double"

    def reader(self, schema: StructType) -> VoxelReader:
        return VoxelReader(dict(self.options))


# ---- arrays --------------------------------------------------------------------------------------------------------

#: Columns and number type of a cell by the option kind; the file doesn't say.
KINDS = {"int": (("val",), "<i4"), "double": (("val",), "<f8"), "pair": (("a", "b"), "<f8")}


def _kind(options: dict[str, str]) -> tuple[tuple[str, ...], np.dtype]:
    kind = options.get("kind", "double")
    if kind not in KINDS:
        raise ValueError(f"no array of kind {kind}; there are {', '.join(KINDS)}")
    return KINDS[kind][0], np.dtype(KINDS[kind][1])


class ArrayReader(ItemReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.values, self.dtype = _kind(options)

    def layout(self, path: str, size: int) -> Layout:
        n = struct.unpack("<Q", _bytes(path, 0, 8))[0]
        shape = struct.unpack(f"<{n}Q", _bytes(path, 8, 8 * n))
        return Layout(8 + 8 * n, int(np.prod(shape, dtype=object)) if n else 1, self.dtype.itemsize * len(self.values), shape)

    def checked(self, path: str, size: int) -> Layout:
        found = super().checked(path, size)
        if size != found.start + found.items * found.width:
            raise ValueError(f"{path} holds no array of this kind")
        return found

    def rows(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        cells = np.frombuffer(data, dtype=self.dtype).reshape(-1, len(self.values))
        place = np.unravel_index(np.arange(first, first + len(cells)), layout.shape) if layout.shape else []
        columns = [pa.array(p.astype(np.int32)) for p in place] + [pa.array(np.ascontiguousarray(c)) for c in cells.T]
        return pa.RecordBatch.from_arrays(columns, names=[*(f"i{k}" for k in range(len(layout.shape))), *self.values])


@dataclass
class Written(WriterCommitMessage):
    cells: int


class ArrayWriter(DataSourceArrowWriter):
    """Tasks write their cells where they belong in a file of the full size beside the target; commit moves it there if every cell was written, else there is an error and
    nothing at the target changes. A task that runs twice writes the same bytes."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.values, self.dtype = _kind(options)
        self.shape = tuple(int(n) for n in options["shape"].split(",") if n.strip())
        self.target = _local(options["path"])
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)
        self.start, self.width = 8 + 8 * len(self.shape), self.dtype.itemsize * len(self.values)
        self.cells = int(np.prod(self.shape, dtype=object))
        self.draft = os.path.join(os.path.dirname(self.target), f".{os.path.basename(self.target)}-{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(self.target), exist_ok=True)
        with open(self.draft, "wb") as f:
            f.write(struct.pack(f"<{len(self.shape) + 1}Q", len(self.shape), *self.shape))
            f.truncate(self.start + self.cells * self.width)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = 0
        with open(self.draft, "r+b") as f:
            for batch in iterator:
                place = [batch.column(f"i{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(self.shape))]
                if any(((p < 0) | (p >= n)).any() for p, n in zip(place, self.shape, strict=True)):
                    raise IndexError("a cell outside the array")
                flat = np.ravel_multi_index(place, self.shape)
                order = np.argsort(flat, kind="stable")
                flat = flat[order]
                cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(self.dtype) for c in self.values], axis=1)[order]
                edges = np.flatnonzero(np.append(True, np.diff(flat) != 1)) if len(flat) else np.zeros(0, dtype=np.int64)
                for low, high in zip(edges, np.append(edges[1:], len(flat)), strict=True):  # cells that follow each other, at once
                    f.seek(self.start + int(flat[low]) * self.width)
                    f.write(cells[low:high].tobytes())
                done += len(flat)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        done = sum(m.cells for m in messages if m is not None)
        if done != self.cells:
            os.unlink(self.draft)
            raise ValueError(f"{done} cells for an array of {self.cells}")
        os.replace(self.draft, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.draft):
            os.unlink(self.draft)


def _local(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a writer needs a shared file system, not {parts.scheme}")
    return os.path.abspath(unquote(parts.path) if parts.scheme else path)


class NdArray(DataSource):
    """i0, i1, ... and val (or a, b): the number of sides, the sides and the cells, last index fastest, in machine order. Options: kind, and shape for writing.

    The schema's indices come from the first file's header; cells are int, double or pairs of doubles.
    """

    @classmethod
    def name(cls) -> str:
        return "ndarray"

    def schema(self) -> str:
        values, dtype = _kind(dict(self.options))
        found = _files(self.options["path"])
        n = struct.unpack("<Q", _bytes(found[0][0], 0, 8))[0] if found else 0
        return ", ".join([*(f"i{k} int" for k in range(n)), *(f"{c} {'int' if dtype.kind == 'i' else 'double'}" for c in values)])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), overwrite)


# ---- blobs ---------------------------------------------------------------------------------------------------------


@dataclass
class Names(WriterCommitMessage):
    names: tuple[str, ...]


class BlobWriter(DataSourceArrowWriter):
    """Tasks write files under names of their own; commit gives them theirs, abort removes them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target = _local(options["path"])
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)
        os.makedirs(self.target, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Names:
        drafts = []
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if os.path.basename(name) != name or name[:1] in "._":
                    raise ValueError(f"no file name: {name}")
                drafts.append(f".{uuid.uuid4().hex}-{name}")
                with open(os.path.join(self.target, drafts[-1]), "wb") as f:
                    f.write(content)
        return Names(tuple(drafts))

    def commit(self, messages: list[Names | None]) -> None:
        for m in messages:
            for draft in m.names if m is not None else ():
                os.replace(os.path.join(self.target, draft), os.path.join(self.target, draft.split("-", 1)[1]))

    def abort(self, messages: list[Names | None]) -> None:
        for m in messages:
            for draft in m.names if m is not None else ():
                if os.path.exists(os.path.join(self.target, draft)):
                    os.unlink(os.path.join(self.target, draft))


class Blobs(DataSource):
    """Sink of (path, content): a file a row, in a folder."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    for source in (Idx, Voxels, NdArray, Blobs):
        spark.dataSource.register(source)
    return spark
