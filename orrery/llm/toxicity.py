"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, discard, materialize, text_chunks
from .learning import MAX_TRAIN, fold, sample

# Characters that look like a Latin letter, and digits and signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # these are dropped
_ODD = re.compile("[­Ͱ-ϿЀ-ԯ​-‍⁠﻿０-ｚ]")
_SIGN = re.compile(r"[0134578@$]")
_SWAP = str.maketrans(SUBSTITUTES)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Lengths of word beginnings that may stand for all words that begin so.
PREFIXES = (4, 5, 6, 7)
#: A pattern is learned if the chance that any candidate were as frequent in toxic text by luck is under this.
CHANCE = 0.2


def fold_text(text: str) -> str:
    """Lower case, homoglyphs and substitutes as letters, words parted by one space, one at either end."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD)
    if _SIGN.search(text):
        words = text.split()
        for i, w in enumerate(words):
            if _SIGN.search(w):
                core = w.lstrip("!#%&*.,;:?\"'()|").rstrip("!#$%&*.,;:?\"'()|")
                if _SIGN.search(core) and any(c.isalpha() for c in core):
                    words[i] = core.translate(_SWAP)
        text = " ".join(words)
    text = _NOT_LETTERS.sub(" ", text).strip()
    return f" {text} " if text else " "


def patterns_of(word: str) -> list[str]:
    """The word itself and its beginnings, as they stand in folded text."""
    return [f" {word} ", *(f" {word[:k]}" for k in PREFIXES if len(word) >= k)]


@dataclass
class Lexicon:
    """Patterns with weights, phrases in which they don't count, and the calibration of a text's two figures."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (w, p))
        for p in self.exceptions:
            found.add_word(p, (None, p))
        found.make_automaton()
        return found

    def hits(self, folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, float, str]]:
        """(start, weight, pattern) of the words with a pattern, outside exception phrases; a word has its heaviest one."""
        if automaton is None:
            return []
        found: dict[int, tuple[float, str]] = {}
        spared = []
        for end, (w, p) in automaton.iter(folded):
            start = end - len(p) + 1
            if w is None:
                spared.append((start, end))
            elif start not in found or found[start][0] < w:
                found[start] = (w, p)
        kept, reach, k = [], -1, 0  # one sweep over hits and exceptions in the order of their starts
        spared.sort()
        for at in sorted(found):
            while k < len(spared) and spared[k][0] <= at:
                reach = max(reach, spared[k][1])
                k += 1
            if at >= reach:
                kept.append((at, *found[at]))
        return kept

    @staticmethod
    def figures(hits: list[tuple[int, float, str]], n_words: int) -> tuple[float, float]:
        """The heaviest pattern's weight; the weight of all occurrences a hundred words, damped."""
        density = 100 * sum(w for _, w, _ in hits) / max(n_words, 1)
        return round(max((w for _, w, _ in hits), default=0.0), 1), round(math.log1p(density), 1)

    def probability(self, figures: tuple[float, float]) -> float:
        b, c, d = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + c * figures[0] + d * figures[1]))))


def _spread(df: DataFrame) -> DataFrame:
    """One document of those that share a min-hash of word triples, by either of two: copies mustn't pass for evidence."""
    for h in ("sketch_a", "sketch_b"):
        df = df.withColumn("first__", F.row_number().over(Window.partitionBy(h).orderBy("doc_id"))).where("first__ = 1").drop("first__")
    return df


def _folded(labelled: DataFrame) -> DataFrame:
    """(doc_id, text, label) -> doc_id, label, folded, sketch_a, sketch_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                folded = [fold_text(t.decode()) for t in texts]
                words = Words([f.encode() for f in folded])
                grams = words.grams(3)
                low = []
                for salt in (0, 0x5851F42D4C957F2D):
                    g = grams * np.uint64(salt | 1)
                    low.append([int(g[a : b - 2].min() >> np.uint64(1)) if b - a >= 3 else hash_of(f) for a, b, f in zip(words.first[:-1], words.first[1:], folded, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array(folded), pa.array(low[0], pa.int64()), pa.array(low[1], pa.int64())],
                    names=["doc_id", "label", "folded", "sketch_a", "sketch_b"],
                )

    return labelled.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, folded string, sketch_a long, sketch_b long")


def hash_of(text: str) -> int:
    """A stable 62-bit hash of a short text."""
    w = Words([text.replace(" ", "_").encode()])
    return int(w.hash[0] >> np.uint64(2)) if len(w.hash) else 0


def learn(docs: DataFrame, labels: DataFrame, held_out_mod: int, held_out_is: int, max_train: int = MAX_TRAIN) -> Lexicon:
    """Learn patterns, exception phrases and calibration from labelled rows outside the held-out ones, max_train at most.

    Pattern counts are summed in partitions and then by Spark; the driver gets those that pass the test of chance.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_out_mod) != held_out_is)).select("doc_id", "label")
    chosen = sample(known, max_train, known.count(), 4)
    train = materialize(_folded(docs.select("doc_id", "text").join(chosen, "doc_id")))
    varied = materialize(_spread(train).select("label", "folded"))
    sizes = {r.label: r.n for r in varied.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({}, [], (-4.0, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pattern: clean documents that have it and its occurrences there; or the size of one toxic document that has it. And all clean words, under no pattern."""
        for batch in batches:
            documents, occurrences, n_words = Counter(), Counter(), 0
            names, sizes = [], []
            for label, folded in zip(batch.column("label").to_pylist(), batch.column("folded").to_pylist(), strict=True):
                words = folded.split()
                found = Counter(p for w, n in Counter(words).items() for p in patterns_of(w) for _ in range(n))
                if label == 1:
                    names += found
                    sizes += [len(words)] * len(found)
                else:
                    documents.update(found.keys())
                    occurrences.update(found)
                    n_words += len(words)
            clean = list(documents)
            columns = [names + clean + [None], sizes + [None] * (len(clean) + 1), [None] * len(names) + [documents[p] for p in clean] + [0], [None] * len(names) + [occurrences[p] for p in clean] + [n_words]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["pattern", "size", "documents", "occurrences"])

    counts = materialize(varied.mapInArrow(count, "pattern string, size long, documents long, occurrences long"))
    clean_words = counts.where("pattern IS NULL").agg(F.sum("occurrences")).first()[0] or 0
    counted = materialize(counts.where("pattern IS NOT NULL").groupBy("pattern").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("clean"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count("size").alias("toxic")))
    n_patterns = max(counted.count(), 1)
    # the chance that a toxic document of some size has the pattern if its words were clean ones; and that so many of them have it
    rate = (F.col("occurrences") + 1.0) / (clean_words + 1.0)
    each = counts.where("size IS NOT NULL").select("pattern", "size").join(counted, "pattern").groupBy("pattern").agg(F.sum(F.log(-F.expm1(-rate * F.col("size")))).alias("by_luck"), F.first("clean").alias("clean"), F.first("toxic").alias("k"))
    n, k = F.lit(float(n_toxic)), F.col("k")
    # or the chance that any document has it, whatever its size: better for patterns that come in bursts. There are two tests, so each gets half the chance
    share = (F.col("clean") + 1.0) / (n_clean + 2.0)
    best = F.least(F.col("by_luck"), F.when(k > share * n, k * F.log(share)).otherwise(F.lit(0.0)))
    luck = F.log(F.lit(2.0 * n_patterns)) + _log_choose(n_toxic, k) + best
    weight = F.log((k + 0.5) / (n + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    rows = each.where((luck < math.log(CHANCE)) & (weight > 0)).select("pattern", weight.alias("weight")).collect()
    discard(counts)
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.pattern), r.pattern)):  # a beginning stands for longer ones that are hardly purer
        if r.weight > 0.5 + max((weights.get(r.pattern[:i], -1.0) for i in range(2, len(r.pattern))), default=-1.0):
            weights[r.pattern] = r.weight
    lexicon = Lexicon(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            seen: Counter = Counter()
            for label, text in zip(batch.column("label").to_pylist(), batch.column("folded").to_pylist(), strict=True):
                found = set()
                for start, _, _ in lexicon.hits(text, auto):
                    stop = text.index(" ", start + 1)
                    left = text.rfind(" ", 0, start) if start else start
                    right = text.find(" ", stop + 1)
                    found |= {text[left : stop + 1] if start else "", text[start : right + 1] if right > 0 else ""}
                seen.update((p, label) for p in found if p)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "label", "n"])

    spared = train.mapInArrow(phrases, "phrase string, label int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    lexicon.exceptions = [r.phrase for r in spared.where("clean >= 3 AND toxic * 20 < clean").orderBy("phrase").collect()]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            f = [lexicon.figures(lexicon.hits(t, auto), t.count(" ") - 1) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64()), batch.column("label").cast(pa.float64())], names=["a", "b", "label"])

    grid = train.mapInArrow(figures, "a double, b double, label double").groupBy("a", "b").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("a", "b").toPandas()
    lexicon.coefficients = logistic(grid[["a", "b"]].to_numpy(), grid.y.to_numpy(), grid.n.to_numpy().astype(float))
    for table in (train, varied, counted):
        discard(table)
    return lexicon


def _log_choose(n: int, k):
    """ln of n over k, by Stirling's series."""
    f = lambda x: (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x)  # noqa: E731  ln x! for x >= 1
    g = lambda x: F.when(x < 1, F.lit(0.0)).otherwise(f(F.greatest(x, F.lit(1.0))))
    kk = k.cast("double")
    return g(F.lit(float(n))) - g(kk) - g(F.lit(float(n)) - kk)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method for a ridge logistic regression on grouped rows."""
    z = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (n * p * (1 - p))[:, None]) + penalty, z.T @ (y - n * p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, text) -> doc_id, score, terms (matched patterns, distinct). Null text counts as empty; an empty text matches nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            for part, texts in text_chunks(batch):
                scores, terms = [], []
                for t in texts:
                    folded = fold_text(t.decode())
                    found = lexicon.hits(folded, auto)
                    scores.append(lexicon.probability(lexicon.figures(found, folded.count(" ") - 1)))
                    terms.append(sorted({p.strip() for _, _, p in found}))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, terms array<string>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out_mod: int = 3, held_out_is: int = 1, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text) and (doc_id, label 0/1) -> doc_id, held_out, score, predicted, n_terms, a row a document.

    Null, empty and blank texts match nothing. Texts are folded and searched whole, in time proportional to their length. Of patterns that begin at one word the heaviest counts, the
    first found of equal ones. Rows may repeat; equal texts get equal scores. Without toxic labels nothing is learned and all scores are low. Labels of held-out
    rows (crc32 of the id modulo held_out_mod is held_out_is; a null id is none) aren't read, nor are null labels. No rows give no rows; other columns don't matter.

    All patterns and exception phrases that pass their tests are kept; they come from the labelled sample, so that max_train bounds them and what tasks hold.
    """
    scored = score(docs, learn(docs, labels.select("doc_id", "label"), held_out_mod, held_out_is, max_train))
    held = F.coalesce(fold("doc_id", held_out_mod) == held_out_is, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("terms").alias("n_terms"))
