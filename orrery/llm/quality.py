"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, filtered, materialize, text_chunks
from .learning import MAX_TRAIN, fold, sample

STATS = ("log_words", "word_length", "distinct_words", "repeats", "distinct_triples", "upper", "symbols", "bars", "bangs", "digits", "points", "newlines", "other_bytes", "ends_in_symbol", "log_lines", "byte_entropy", "longest_word")
#: Random Fourier features, their seed, the kernel's width in standard deviations of a statistic, and the ridge a row.
N_FEATURES, SEED, WIDTH, RIDGE = 192, 7, 3.0, 1e-3

_CLASS = np.full(256, 7, dtype=np.int64)  # symbols
for _c, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!")):
    _CLASS[list(_bytes)] = _c
_CLASS[ord("|")] = 8
_CLASS[128:] = 9


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS a text; an empty text has zeros."""
    n = len(texts)
    words = Words(texts)
    size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=n)
    of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_byte * 10 + _CLASS[words.buf], minlength=10 * n).reshape(n, 10).astype(float)
    kinds[:, 4] -= 1  # the separator that follows each text
    n_words = np.diff(words.first)
    doc = np.repeat(np.arange(n), n_words)
    count = lambda which: np.bincount(which, minlength=n).astype(float)
    salted = lambda h, d: h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def distinct(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        order = np.argsort(key := salted(h, d))
        new = np.ones(len(h), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        return count(d[order][new])

    same = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    grams = words.grams(3)
    inside = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, dtype=bool)
    n_grams = np.maximum(n_words - 2, 0)
    last = _CLASS[words.buf[words.end - 1]]
    length = (words.end - words.start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    share = np.bincount(of_byte * 256 + words.buf, minlength=256 * n).reshape(n, 256).astype(float)
    share[:, 10] -= 1  # the separator again
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    per = lambda a, b: a / np.maximum(b, 1)
    letters = kinds[:, 0] + kinds[:, 1]
    total = kinds.sum(axis=1)
    return np.column_stack([
        np.log1p(n_words), per(np.bincount(doc, weights=length, minlength=n), n_words),
        per(distinct(words.hash, doc), n_words), per(count(doc[1:][same]), n_words), per(distinct(grams[inside], doc[2:][inside]) if len(grams) else np.zeros(n), n_grams),
        per(kinds[:, 0], letters), per(kinds[:, 7], total), per(kinds[:, 8], n_words), per(kinds[:, 6], n_words), per(kinds[:, 2], total),
        per(kinds[:, 5], n_words), per(kinds[:, 4], n_words), per(kinds[:, 9], total), per(count(doc[(last == 7) | (last == 6)]), n_words), np.log1p(kinds[:, 4]), entropy, np.log1p(longest),
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, stats array<float>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                flat = pa.array(statistics(texts).astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(STATS)), flat)], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<float>")


class Model:
    """Random features cos(w x + b) of standardised statistics, weights, and the calibration's steps."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(scale=1 / WIDTH, size=(len(mean), N_FEATURES - 1))
        self.b = rng.uniform(0, 2 * np.pi, size=N_FEATURES - 1)
        self.beta = np.zeros(N_FEATURES)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / N_FEATURES)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y_sum: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ordered x with sums and counts of labels -> block centres and their rising means."""
    blocks: list[list[float]] = []
    for at, s, k in zip(x, y_sum, n, strict=True):
        blocks.append([at * k, s, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATS)).astype(float)


def fit(stats: DataFrame, labels: DataFrame, held_out_mod: int, held_out_is: int, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows outside the held-out ones, max_train at most.

    Each partition sums its normal equations; the sums of all are added by Spark, and the driver gets N_FEATURES^2 / 2 numbers.
    """
    known = stats.join(labels.where(F.col("label").isNotNull()), "doc_id").where(F.col("doc_id").isNotNull() & (fold("doc_id", held_out_mod) != held_out_is))
    n = known.count()
    if not n:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    train = materialize(sample(known, max_train, n, 8).select("stats", F.col("label").cast("double").alias("label")).repartition(8))  # after the sample: what is shuffled is bounded, and what comes before keeps its tasks
    moments = train.select([f(F.col("stats")[i].cast("double")) for i in range(len(STATS)) for f in (F.avg, F.stddev_pop)]).first()
    model = Model(np.array(moments[0::2], dtype=float), np.array(moments[1::2], dtype=float))
    upper = np.triu_indices(N_FEATURES + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 1))
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch)), batch.column("label").to_numpy()])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    rows = train.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((N_FEATURES + 1, N_FEATURES + 1))
    gram[rows.i, rows.j] = gram[rows.j, rows.i] = rows.v
    penalty = RIDGE * max(n if n < max_train else max_train, 1) * np.eye(N_FEATURES)
    penalty[0, 0] = 0
    model.beta = np.linalg.solve(gram[:-1, :-1] + penalty + 1e-9 * np.eye(N_FEATURES), gram[:-1, -1])

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.raw(_matrix(batch)), 3)), batch.column("label")], names=["raw", "label"])

    bins = train.mapInArrow(raws, "raw double, label double").groupBy("raw").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("raw").toPandas()
    model.steps = isotonic(bins.raw.to_numpy(), bins.y.to_numpy(), bins.n.to_numpy().astype(float))
    discard(train)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_mod: int = 5, held_out_is: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text) and (doc_id, label 0/1) -> doc_id, held_out, score, predicted, a row a document.

    Null text counts as empty; an empty text's statistics are zeros and it gets a score like any other. Statistics cover whole texts, of any length. Rows may repeat;
    equal texts get equal scores. Without any labelled row every score is 0.5. Labels of held-out rows (crc32 of the id modulo held_out_mod is held_out_is; a
    null id is none) aren't read, nor are null labels. No rows give no rows; other columns don't matter.
    """
    stats = materialize(document_statistics(docs))
    model = fit(stats, labels.select("doc_id", "label"), held_out_mod, held_out_is, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", held_out_mod) == held_out_is, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_mod: int = 5, held_out_is: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows of docs (doc_id, text and any others, of any name) whose score is threshold or more, unchanged. The model is classify()'s, and so is what becomes of
    null, empty and long texts, repeated rows and missing labels; text isn't shuffled."""
    names = labels.select(F.col("doc_id").alias("known__"))
    stats = materialize(document_statistics(docs.select("doc_id", "text")).join(names, F.col("doc_id") == F.col("known__"), "left_semi"))
    model = fit(stats, labels.select("doc_id", "label"), held_out_mod, held_out_is, max_train)
    discard(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                yield part.filter(pa.array(model.score(statistics(texts).astype(np.float32).astype(float)) >= threshold))

    return filtered(docs, run)
