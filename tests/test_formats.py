import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import formats


@pytest.fixture(scope="module")
def source(spark):
    return formats.register(spark)


def test_one_idx_file_is_several_tasks(source, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (100, 6), dtype=np.uint8)
    (tmp_path / "images").write_bytes(struct.pack(">4i", 2051, 100, 2, 3) + px.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">2i", 2049, 100) + bytes(range(100)))
    df = source.read.format("idx").option("splitBytes", 60).load(str(tmp_path / "images"))
    assert df.rdd.getNumPartitions() == 10
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(100)) and np.allclose([r.features for r in rows], px / np.float32(255))
    labels = source.read.format("idx").option("splitBytes", 33).load(f"file://{tmp_path}/labels")
    assert labels.rdd.getNumPartitions() == 4 and [r.label for r in labels.orderBy("id").collect()] == list(range(100))


def test_idx_files_that_lie(source, tmp_path):
    for name, content in (("other", struct.pack(">4i", 7, 1, 1, 1) + b"x"), ("short", struct.pack(">4i", 2051, 9, 2, 3) + b"x" * 53)):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match="not an IDX|shorter"):
            source.read.format("idx").load(str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="FileNotFound|No such|nothing"):
        source.read.format("idx").load(str(tmp_path / "nothing")).collect()


def test_one_volume_is_several_tasks(source, tmp_path):
    val = np.arange(5 * 4 * 3, dtype="<u2")
    (tmp_path / "a.dat").write_bytes(struct.pack("<3H", 5, 4, 3) + val.tobytes())
    (tmp_path / "b.fld").write_bytes(b"# c\nndim=3\ndim1=5\ndim2=4\ndim3=3\ndata=byte\n\f\f" + val.astype(np.uint8).tobytes())
    df = source.read.format("voxels").option("splitBytes", 14).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 9 + 5
    for name in ("a.dat", "b.fld"):
        got = {(r.x, r.y, r.z): r.val for r in df.where(F.col("path").endswith(name)).collect()}
        assert got == {(i % 5, i // 5 % 4, i // 20): float(i) for i in range(60)}


@pytest.mark.parametrize(("kind", "shape"), [("int", (3,)), ("int", (3, 4)), ("int", (3, 4, 5)), ("double", (3, 4, 5)), ("pair", (3, 4, 5))])
def test_arrays_there_and_back(source, tmp_path, kind, shape):
    cells = [(*map(int, at), *((float(sum(at)), float(at[0] + at[1] // (at[2] + 1))) if kind == "pair" else (sum(map(int, at)) if kind == "int" else sum(at) / 3,))) for at in np.ndindex(*shape)]
    names = [*(f"i{k} int" for k in range(len(shape))), *(["a double", "b double"] if kind == "pair" else [f"val {kind}"])]
    df = source.createDataFrame(cells, ", ".join(names))
    path = str(tmp_path / "array.bin")
    df.repartition(3).write.format("ndarray").options(shape=",".join(map(str, shape)), kind=kind).mode("overwrite").save(path)
    dtype = {"int": "<i4", "double": "<f8", "pair": "<f8"}[kind]
    want = struct.pack(f"<{len(shape) + 1}Q", len(shape), *shape) + np.array([c[len(shape) :] for c in cells], dtype=dtype).tobytes()
    assert open(path, "rb").read() == want and os.listdir(tmp_path) == ["array.bin"]
    back = source.read.format("ndarray").options(kind=kind, splitBytes=40).load(path)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, back.collect())) == cells
    assert kind == "int" and len(shape) == 1 or back.rdd.getNumPartitions() > 1


def test_arrays_with_gaps_change_nothing(source, tmp_path):
    path = tmp_path / "array.bin"
    path.write_bytes(b"as it was")
    write = lambda df: df.write.format("ndarray").options(shape="4").mode("overwrite").save(str(path))
    cells = lambda *at: source.createDataFrame([(i, 1.0) for i in at], "i0 int, val double")
    for bad in (cells(0, 1, 2), cells(0, 1, 2, 4), cells(-1, 0, 1, 2)):
        with pytest.raises(Exception, match="cells for an array|outside"):
            write(bad)
        assert path.read_bytes() == b"as it was" and os.listdir(tmp_path) == ["array.bin"]
    write(cells(3, 1, 0, 2))
    assert len(path.read_bytes()) == 16 + 32
    with pytest.raises(Exception, match="no array of this kind|shorter"):
        source.read.format("ndarray").options(kind="pair").load(str(path)).collect()
    with pytest.raises(Exception, match="shared file system"):
        cells(0).write.format("ndarray").options(shape="1").mode("overwrite").save("hdfs://nowhere/a")


def test_blobs(source, tmp_path):
    rows = source.createDataFrame([(f"{k}.dat", bytes([k] * k)) for k in range(1, 6)], "path string, content binary").repartition(3)
    rows.write.format("blobs").mode("overwrite").save(str(tmp_path / "out"))
    assert {f: open(tmp_path / "out" / f, "rb").read() for f in os.listdir(tmp_path / "out")} == {f"{k}.dat": bytes([k] * k) for k in range(1, 6)}
    with pytest.raises(Exception, match="no file name"):
        source.createDataFrame([("../x", b"")], "path string, content binary").write.format("blobs").mode("overwrite").save(str(tmp_path / "out"))
