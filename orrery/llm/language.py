"""Language identification: nearest of several centroids a language in TF-IDF n-gram space, by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_chunks
from .learning import drawn, fold

#: Dimensions of the hashed 2- and 3-byte n-gram space, and centroids a language.
DIMS, CENTROIDS = 4096, 4
#: Training documents a language that centroids are clustered from, at most. Document frequencies come from all of them.
MAX_PER_LANGUAGE = 500
#: Rows that are counted at once: each takes DIMS numbers, however short its text is.
ROWS = 512
#: A text is rejected if its cosine is under its centroid's mean over members less so many standard deviations.
REJECT_SIGMAS = 5.0

_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts (texts x DIMS) of the letters; runs of other characters are one gap."""
    n = len(texts)
    folded = [b" " + b" ".join(t.translate(_LETTERS).split()) + b" " for t in texts]
    buf = np.frombuffer(b"".join(folded), dtype=np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(n), [len(t) for t in folded])
    found = np.zeros(n * DIMS, dtype=np.float32)
    for k in (2, 3):
        if len(buf) < k:
            continue
        m = len(buf) - k + 1
        key = buf[:m].copy()
        for j in range(1, k):
            key = (key << 8) | buf[j : j + m]
        inside = doc[:m] == doc[k - 1 :]
        where = ((key * np.uint32(2654435761 if k == 3 else 2246822519)) >> np.uint32(20)).astype(np.int64)
        found += np.bincount((doc[:m] * DIMS + where)[inside], minlength=n * DIMS)[: n * DIMS]
    return found.reshape(n, DIMS)


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(c.isalpha() for c in text.decode())


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + log tf) idf."""
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def cluster(v: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts: unit centroids and each one's rejection bound."""
    picks = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(picks) < min(k, len(v)):
        picks.append(int(np.argmin((v @ v[picks].T).max(axis=1))))
    c = v[picks]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    c = c[np.bincount(own, minlength=len(c)) >= 0.05 * len(v)]  # a few odd texts make no cluster
    cosine = v @ c.T
    own = np.argmax(cosine, axis=1)
    best = cosine.max(axis=1)
    bound = [best[own == i].mean() - REJECT_SIGMAS * best[own == i].std() if (own == i).sum() > 2 else 0.0 for i in range(len(c))]
    return c, np.clip(bound, 0.02, 1)


def fit(known: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, k: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(doc_id, text, lang) rows to learn from -> idf, and lang, centroid and bound of each cluster.

    Document frequencies are counted over all rows, summed a partition and then by Spark. A language's clusters come from a sample.
    """
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS), 0
        for batch in batches:
            for _, texts in text_chunks(batch, rows=ROWS):
                df += (counts(texts) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(np.append(df, n))], names=["dim", "df"])

    df = known.select("text").mapInArrow(frequencies, "dim int, df double").groupBy("dim").agg(F.sum("df").alias("df")).toPandas()
    freq = np.zeros(DIMS + 1)
    freq[df.dim] = df.df
    idf = np.log((1 + freq[-1]) / (1 + freq[:-1])) + 0.1

    # one scan for all languages, each with a rate of its own
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("of"), "n"))
    picked = known.join(sizes, F.col("lang") == F.col("of")).where(drawn(10, max_per_language, F.col("n")))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, rows=ROWS):
                v = vectors(counts(texts), idf)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(v), pa.list_(pa.float32()))], names=["lang", "v"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        c, bound = cluster(np.stack(pdf.v), k)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "centroid": list(c), "bound": bound})

    found = picked.select("lang", "text").mapInArrow(embed, "lang string, v array<float>").groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, bound double")
    rows = sorted(found.collect(), key=lambda r: (r.lang, list(r.centroid)))
    discard(sizes)
    return idf, [r.lang for r in rows], np.array([r.centroid for r in rows], dtype=np.float32).reshape(-1, DIMS), np.array([r.bound for r in rows])


def identify(docs: DataFrame, held_out_mod: int = 4, held_out_is: int = 2, max_per_language: int = MAX_PER_LANGUAGE, reject: str | None = "und") -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score (cosine), rejected.

    Text that is null, empty or without a letter is "und" with score 0. A text too far from its nearest centroid is rejected: its
    lang_pred becomes reject, or stays the nearest language if that is None. Held-out rows (crc32 of the id modulo held_out_mod is held_out_is;
    a null id is none) and rows without id or lang aren't learned from; without any to learn from, all is "und". Texts are counted whole, of any length. Of
    centroids equally near, the first by language and coordinates counts. Rows may repeat; equal texts get equal results. No rows give no rows; other columns don't matter.
    """
    held = F.coalesce(fold("doc_id", held_out_mod) == held_out_is, F.lit(False))
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    idf, langs, centroids, bounds = fit(known, max_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, rows=ROWS):
                n = len(texts)
                named, score, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
                lettered = np.array([has_letter(t) for t in texts])
                if langs and lettered.any():
                    cosine = vectors(counts(texts), idf) @ centroids.T
                    best = np.argmax(cosine, axis=1)
                    score = np.where(lettered, np.clip(cosine[np.arange(n), best], 0, 1), 0)
                    rejected = lettered & (score < bounds[best])
                    named = np.where(lettered, np.array(langs, dtype=object)[best], "und")
                    if reject is not None:
                        named = np.where(rejected, reject, named)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(named), pa.string()), pa.array(score.astype(float)), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
