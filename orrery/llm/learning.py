"""What the trained operators share: held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most (a sample by the hash of the id beyond it).
MAX_TRAIN = 20_000


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def fraction(seed: int, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from 53 bits of a hash of the id: fine enough for a sample of any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) * F.lit(2.0**-53)


def drawn(seed: int, most: int, n: int | Column) -> Column:
    """Whether a row is among about most of n, the same ones in every run; all are if n is no more."""
    return fraction(seed) * n < most


def sample(df: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    """About most of df's n rows, by a hash of doc_id; all if n is no more."""
    return df if n <= most else df.where(drawn(seed, most, n))
