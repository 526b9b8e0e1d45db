"""Helpers shared by the corpus operators: shared tables, Arrow chunking, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is one step of its own.
CHUNK_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-shared-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The library beside this subpackage has a function of its own for this, as neither imports the other.
    """
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def filtered(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of docs that run leaves in their batches; columns may have any name, also one with a dot, which mapInArrow() alone can't have."""
    plain = docs.toDF(*(c if c.isidentifier() else f"column {k}" for k, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def text_chunks(batch: pa.RecordBatch, column: str = "text", rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most CHUNK_BYTES of text (or one row) and at most so many rows, and their texts as UTF-8 bytes; null is empty."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and (total + n > CHUNK_BYTES or i - at == rows):
            yield batch.slice(at, i - at), [x or b"" for x in texts[at:i]]
            at, total = i, 0
        total += n
    if at < len(texts):
        yield batch.slice(at), [x or b"" for x in texts[at:]]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it, within other functions over arrays too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of several texts: runs of bytes other than ASCII white space, hashed together.

    start, end: byte spans in buf; first: index of each document's first word (one more entry at the end); hash: 64 bits a word.
    """

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = buf
        word = (buf != 32) & ((buf < 9) | (buf > 13))
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, offset)
        up, down = _pow(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the document are meaningless."""
        n = len(self.hash)
        up, down = _pow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        self.sums, self.down = sums, down
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        return mix64((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of words start..stop (after grams())."""
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
