import struct

import numpy as np
import pytest

from orrery.sources import binary, matrices


def test_idx(spark, tmp_path):
    px = np.arange(3 * 2 * 4, dtype=np.uint8).reshape(3, 8)
    (tmp_path / "images").write_bytes(struct.pack(">4i", 2051, 3, 2, 4) + px.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">2i", 2049, 3) + bytes([7, 0, 9]))
    rows = binary.read_idx_images(spark, str(tmp_path / "images")).orderBy("id").collect()
    assert np.allclose([r.features for r in rows], px / np.float32(255))
    assert [r.label for r in binary.read_idx_labels(spark, str(tmp_path / "labels")).orderBy("id").collect()] == [7, 0, 9]
    with pytest.raises(Exception, match="not an IDX"):
        binary.read_idx_images(spark, str(tmp_path / "labels")).collect()


def test_volumes(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(struct.pack("<3H", 3, 2, 2) + np.arange(12, dtype="<u2").tobytes())
    head = b"# a comment\nndim=3\ndim1=3\ndim2=2\ndim3=2\nnspace=3\nveclen=1\ndata=byte\nfield=uniform\n"
    (tmp_path / "b.FLD").write_bytes(head + b"\f\f" + bytes(range(12)))
    for name in ("a.dat", "b.FLD"):
        rows = binary.read_volume(spark, str(tmp_path / name)).collect()
        assert {(r.x, r.y, r.z): r.val for r in rows} == {(i % 3, i // 3 % 2, i // 6): float(i) for i in range(12)}, name
    with pytest.raises(ValueError):
        binary.read_volume(spark, "x.raw")


def test_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b,c\n1,2,3\n4,x,6\n7,8\n")
    got = [r.features for r in matrices.read_matrix(spark, str(tmp_path / "m.csv"), 3).collect()]
    assert got == [[1.0, 2.0, 3.0], [4.0, None, 6.0], [7.0, 8.0, None]]
    (tmp_path / "m.ssv").write_text("1 2\n3 4\n")
    assert [r.features for r in matrices.read_matrix(spark, str(tmp_path / "m.ssv"), 2, " ", False).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    cols = matrices.read_columns(spark, str(tmp_path / "m.csv"))
    assert cols.columns == ["a", "b", "c"] and [r.b for r in cols.collect()] == [2.0, None, 8.0]
    (tmp_path / "l.txt").write_text("b\na\nb\nc\na\n")
    assert [(r.line, r.label, r.code) for r in matrices.read_labels(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == [(0, "b", 0), (1, "a", 1), (2, "b", 0), (3, "c", 2), (4, "a", 1)]
    assert [r.label for r in matrices.read_labels(spark, str(tmp_path / "l.txt"), 2).orderBy("line").collect()] == ["b", "b", "a"]
