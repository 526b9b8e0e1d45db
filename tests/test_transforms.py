import numpy as np
import pytest

from orrery.operators import interpolation, spectral


def table(spark, z, first=0):
    return spark.createDataFrame([(first + n, float(v.real), float(v.imag)) for n, v in enumerate(z)], "n long, re double, im double").repartition(3)


def values(df, key="k"):
    rows = sorted((r[key], r.re, r.im) for r in df.collect())
    assert [k for k, *_ in rows] == list(range(len(rows)))
    return np.array([complex(re, im) for _, re, im in rows])


@pytest.mark.parametrize("n", [1, 2, 3, 8, 255, 500])
def test_any_length(spark, n):
    rng = np.random.default_rng(n)
    z = rng.random(n) + 1j * rng.random(n)
    there = spectral.fft_any(table(spark, z))
    assert np.allclose(values(there), np.fft.fft(z), atol=1e-9)
    assert np.allclose(values(spectral.fft_any(there.withColumnRenamed("k", "n"), n, inverse=True)), z, atol=1e-9)


def test_no_values(spark):
    assert spectral.fft_any(table(spark, [])).count() == 0
    assert spectral.fft_2d(spark.createDataFrame([], "y int, x int, re double, im double")).count() == 0


def test_chirps_keep_their_digits(spark):
    """The square of a place far out is reduced exactly."""
    n = 100_003
    places = [0, 1, 2_999, 99_999, 100_002]
    df = spark.createDataFrame([(p,) for p in places], "n long")
    got = [(r.c, r.s) for r in df.select("n", *(c.alias(x) for c, x in zip(spectral._chirp("n", n, -1), "cs", strict=True))).orderBy("n").collect()]
    want = [np.exp(-1j * np.pi * (p * p % (2 * n)) / n) for p in places]
    assert np.allclose([complex(*x) for x in got], want, atol=1e-12)


@pytest.mark.parametrize("shape", [(1, 1), (2, 8), (64, 16)])
def test_lines_are_cut(spark, shape):
    rng = np.random.default_rng(sum(shape))
    z = rng.random(shape) + 1j * rng.random(shape)
    grid = spark.createDataFrame([(int(y), int(x), float(z[y, x].real), float(z[y, x].imag)) for y, x in np.ndindex(*shape)], "y int, x int, re double, im double")
    rows = spectral.fft_2d(grid)
    got = np.zeros(shape, dtype=complex)
    for r in rows.collect():
        got[r.y, r.x] += complex(r.re, r.im)
    assert rows.count() == z.size and np.allclose(got, np.fft.fft2(z))
    for r in spectral.fft_2d(rows, inverse=True).collect():
        assert abs(complex(r.re, r.im) - z[r.y, r.x]) < 1e-9


def test_many_lines_at_once(spark):
    rng = np.random.default_rng(0)
    z = rng.random((5, 32))
    lines = spark.createDataFrame([(line, n, float(z[line, n]), 0.0) for line in range(5) for n in range(32)], "line long, n long, re double, im double")
    got = np.zeros((5, 32), dtype=complex)
    for r in spectral.fft_lines(lines, 32).collect():
        got[r.line, r.k] = complex(r.re, r.im)
    assert np.allclose(got, np.fft.fft(z, axis=1))
    with pytest.raises(ValueError, match="power of two"):
        spectral.fft_lines(lines, 33)


def test_grid_as_rows_gives_what_one_task_gives(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))], "id long, x double, y double").cache()
    a, b = (sorted(map(tuple, f(points, 4, 4).collect())) for f in (interpolation.potentials, interpolation.potentials_by_lines))
    assert len(a) == 200 and np.allclose(a, b, atol=1e-9)
