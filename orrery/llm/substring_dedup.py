"""Recurring passages: found by anchors, confirmed, and located in all documents by sharded Aho-Corasick automata."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, discard, materialize, mix64, text_chunks

#: Words a window, and words an anchor phrase. Every window holds WINDOW - ANCHOR + 1 phrases, of which the least hash is its anchor.
WINDOW, ANCHOR = 50, 10
#: Bytes of text a shard of documents; each shard has an automaton of its own.
SHARD_BYTES = 4 << 20

_PLACE = np.uint64((1 << 28) - 1)
_GAP = re.compile(rb"[\t-\r ]")


class Segments:
    """Runs of windows with the same anchor, of all texts of a chunk.

    The anchor is the leftmost phrase with the least hash, which the window's words alone decide: equal windows have equal anchors at equal places.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        words = Words(texts)
        n = len(words.hash)  # under 2^28, as texts come in slices
        phrases = words.grams(ANCHOR)
        self.words, self.window = words, window
        self.doc = self.start = self.stop = self.anchor = np.zeros(0, dtype=np.int64)
        self.phrase = self.hash = np.zeros(0, dtype=np.uint64)
        if n < window:
            return
        low = (phrases & ~_PLACE) | np.arange(len(phrases), dtype=np.uint64)
        span, width = window - ANCHOR + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        if not len(at):
            return
        anchor = (low[at] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
        last = np.append(new[1:], len(at)) - 1
        self.start, self.stop = at[new], at[last] + window
        self.doc, self.anchor = doc[self.start], anchor[new]
        self.phrase = phrases[self.anchor]
        self.hash = mix64(words.span(self.start, self.stop) + (self.anchor - self.start).astype(np.uint64))


def slices(text: bytes, most: int, overlap: int) -> Iterator[tuple[int, bytes]]:
    """A text in slices of about most bytes, cut between words, each with the number of its first word. The last overlap words of a slice begin the next one."""
    at, number, size = 0, 0, most
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        words = Words([text[at : gap.start() if gap else len(text)]])
        n = len(words.start)
        if n <= overlap:  # words so long that a slice has too few
            size *= 2
            continue
        yield number, text[at : gap.start() if gap else len(text)]
        at, number, size = at + int(words.start[n - overlap]), number + n - overlap, most
    yield number, text[at:]


def segments(docs: DataFrame, window: int = WINDOW, slice_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, phrase, segment (hashes), start (word number), length, offset of the anchor. A long text is cut into slices whose windows are all of its windows, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                long = len(texts) == 1 and len(texts[0]) > slice_bytes
                work = [([piece], number) for number, piece in slices(texts[0], slice_bytes, window - 1)] if long else [(texts, 0)]
                for pieces, number in work:
                    s = Segments(pieces, window)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(s.doc)), pa.array(s.phrase.view(np.int64)), pa.array(s.hash.view(np.int64)), pa.array(s.start - s.words.first[s.doc] + number, pa.int32()), pa.array(s.stop - s.start, pa.int16()), pa.array(s.anchor - s.start, pa.int16())],
                        names=["doc_id", "phrase", "segment", "start", "length", "offset"],
                    )

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, phrase long, segment long, start int, length short, offset short")


def _runs(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Texts of the wanted segments (doc_id, segs array<struct>): those that touch make one run of words.

    doc_id, run (its first word's number), passage, and segs: each one's phrase, segment, place (of its anchor in the run) and, if it has variants, hashes of its windows.
    """
    seg_type = pa.struct([("phrase", pa.int64()), ("segment", pa.int64()), ("place", pa.int32()), ("windows", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                rows: dict[str, list] = {"doc_id": [], "run": [], "passage": [], "segs": []}
                for k, (doc_id, segs) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("segs").to_pylist(), strict=True)):
                    own = texts[k].split()
                    runs: list[tuple[int, int, list]] = []
                    for g in sorted(segs, key=lambda g: g["start"]):
                        stop = g["start"] + g["length"]
                        if stop > len(own):
                            continue  # another row with this id
                        if runs and g["start"] <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]), runs[-1][2])
                        else:
                            runs.append((g["start"], stop, []))
                        runs[-1][2].append(g)
                    for start, stop, listed in runs:
                        passage = b" ".join(own[start:stop])
                        words = Words([passage])
                        words.grams(ANCHOR)
                        found = []
                        for g in listed:
                            low = g["start"] - start
                            at = np.arange(low, low + g["length"] - window + 1 if g["varies"] else low)
                            found.append({"phrase": g["phrase"], "segment": g["segment"], "place": low + g["offset"], "windows": words.span(at, at + window).view(np.int64)})
                        rows["doc_id"].append(doc_id)
                        rows["run"].append(start)
                        rows["passage"].append(passage.decode())
                        rows["segs"].append(found)
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["run"], pa.int32()), pa.array(rows["passage"], pa.string()), pa.array(rows["segs"], pa.list_(seg_type))], names=list(rows))

    both = docs.select("doc_id", "text").join(wanted, "doc_id")
    return both.mapInArrow(run, "doc_id long, run int, passage string, segs array<struct<phrase: long, segment: long, place: int, windows: array<long>>>")


def automaton_of(passages: Iterable[tuple[int, int, list[str]]]) -> ahocorasick.Automaton | None:
    """Anchor phrases, each with the passages (document, place of the anchor, words) around it."""
    by_phrase: dict[str, list] = defaultdict(list)
    for p in passages:
        by_phrase[" " + " ".join(p[2][p[1] : p[1] + ANCHOR]) + " "].append(p)
    if not by_phrase:
        return None
    found = ahocorasick.Automaton()
    for phrase, listed in by_phrase.items():
        found.add_word(phrase, (len(phrase), sorted(listed, key=lambda p: p[0])))
    found.make_automaton()
    return found


def covered(doc_id: int, words: list[str], automaton: ahocorasick.Automaton, window: int) -> list[tuple[int, int]]:
    """Merged word spans that agree with passages of smaller documents over a window or more."""
    text = " " + " ".join(words) + " "
    starts: list[int] | None = None
    spans = []
    reach: dict[tuple[int, int], int] = {}
    for end, (length, passages) in automaton.iter(text):
        if passages[0][0] >= doc_id:
            continue
        if starts is None:
            starts = list(accumulate((len(w) + 1 for w in words), initial=1))
        at = bisect_left(starts, end - length + 2)
        for doc, place, p in passages:
            if doc >= doc_id:
                break
            shift = at - place
            if reach.get((id(p), shift), 0) > at:
                continue  # a hit before it went as far with the same passage
            a, b = place, place + ANCHOR
            while a and shift + a > 0 and words[shift + a - 1] == p[a - 1]:
                a -= 1
            while b < len(p) and shift + b < len(words) and words[shift + b] == p[b]:
                b += 1
            reach[id(p), shift] = shift + b
            if b - a >= window:
                spans.append((shift + a, shift + b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, spans (of removed words), kept_text: each word goes that a window covers whose words also start in a
    document with a smaller id.

    1. Windows of a document fall into segments by their anchors. A phrase that anchors windows of one document only has nothing to say.
    2. Each distinct segment of a recurring phrase gets its text from its first document. Where a phrase has several variants of its segment,
       their windows are grouped to see which variant has each window first.
    3. Documents are dealt to shards of about shard_bytes. A shard gets the passages that its documents' segments point to, compiles their anchor
       phrases into an automaton, and streams its documents through it; a hit counts as far as the words themselves agree.

    Hashes (128 bits each: of a phrase with its segment, of a phrase with a window) choose which passages reach a shard, so that two different ones with the
    same hash could lose a removal; what is removed is always equal word for word. A document compares windows as they are in the input. Null and empty texts have no
    words. A null id is neither smaller nor larger than any, so it keeps all. Rows with equal id, whether their texts are equal or not, don't remove from each other, but
    from later ones. Texts under a window of words stay whole; those of any length are taken whole, in slices where they are hashed. No rows give no rows; other columns don't matter.
    """
    everything = materialize(segments(docs, window))
    # aggregates become tables before large sides join them: then these joins are ones that Spark may split
    recurring = everything.groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("phrase")
    recurring = materialize(recurring)
    found = materialize(everything.join(recurring, "phrase", "left_semi"))
    discard(everything)
    discard(recurring)
    key = ["phrase", "segment"]
    distinct = materialize(found.groupBy(*key).agg(F.min(F.struct("doc_id", "start", "length", "offset")).alias("at")))
    varied = materialize(distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("variants")))
    firsts = distinct.join(varied, "phrase").select("phrase", "segment", (F.col("variants") > 1).alias("varies"), "at.*")
    wanted = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("phrase", "segment", "start", "length", "offset", "varies")).alias("segs"))
    runs = materialize(_runs(docs, wanted, window))
    segs = runs.select("doc_id", "run", F.explode("segs").alias("s"))
    places = segs.select("s.phrase", F.col("s.segment").alias("from"), "doc_id", "run", "s.place")

    windows = segs.select("s.phrase", "s.segment", "doc_id", F.explode("s.windows").alias("window"))
    first = windows.groupBy("phrase", "window").agg(F.min(F.struct("doc_id", "segment")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase", "window", F.col("src.segment").alias("from"))
    crossed = windows.join(materialize(first), ["phrase", "window"]).where(F.col("segment") != F.col("from")).select(*key, "from").distinct()
    sources = distinct.select(*key, F.col("segment").alias("from")).unionByName(crossed)

    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, -(-total // shard_bytes))
    # an id of so many rows that their texts are more than a shard's is in as many pieces, each of which gets the id's passages
    sized = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.count(F.lit(1)).alias("n"))
    many = materialize(sized.where((F.col("n") > 1) & (F.col("size") > shard_bytes)).select(F.col("doc_id").alias("id__"), F.ceil(F.col("size") / shard_bytes).cast("int").alias("pieces")))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_shards)).cast("int").alias("shard")
    rows, asked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.lit(0).alias("piece")), found.withColumn("piece", F.lit(0))
    if not many.isEmpty():
        several = F.col("doc_id") == F.col("id__")
        dealt = docs.select("doc_id", "text").join(many, several).select("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.col("pieces").cast("long")).cast("int").alias("piece"))
        rows = rows.join(many, several, "left_anti").unionByName(materialize(dealt))  # a table, as the pieces must stay what they are
        asked = asked.drop("piece").join(many, several, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    needed = asked.select(shard, *key, "doc_id").groupBy("shard", *key).agg(F.max("doc_id").alias("last")).join(sources, key)
    placed = needed.join(places, ["phrase", "from"]).where(F.col("doc_id") < F.col("last"))  # a shard needs no passage of a document that none of its own comes after
    placed = placed.groupBy("shard", "doc_id", "run").agg(F.collect_set("place").alias("places"))
    routed = placed.join(runs.select("doc_id", "run", "passage"), ["doc_id", "run"]).select("shard", "doc_id", "places", "passage")

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept_text", pa.string())])

    def locate(texts: pa.Table, known: pa.Table) -> pa.Table:
        listed = ((d, places, p.split(" ")) for d, places, p in zip(*(known.column(c).to_pylist() for c in ("doc_id", "places", "passage")), strict=True))
        auto = automaton_of((d, a, words) for d, places, words in listed for a in places)
        rows: dict[str, list] = {c: [] for c in out.names}
        for doc_id, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            words = b" ".join((text or b"").split()).decode()
            words = words.split(" ") if words else []
            spans = covered(doc_id, words, auto, window) if auto is not None and doc_id is not None and len(words) >= window else []
            rows["doc_id"].append(doc_id)
            rows["n_words"].append(len(words))
            rows["spans"].append([{"start": a, "stop": b} for a, b in spans])
            for a, b in reversed(spans):
                del words[a:b]
            rows["kept_text"].append(" ".join(words))
        return pa.table(rows, schema=out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = pa.table({"doc_id": pa.array([], pa.int64()), "places": pa.array([], pa.list_(pa.int64())), "passage": pa.array([], pa.string())})
        for batch in batches:
            yield from locate(pa.Table.from_batches([batch]), nothing).to_batches()

    kinds = "doc_id long, n_words long, spans array<struct<start: int, stop: int>>, kept_text string"
    left = rows.select(shard, "doc_id", "text").groupBy("shard")
    without_id = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # these keep all, wherever they are
    return left.cogroup(routed.groupBy("shard")).applyInArrow(locate, kinds).unionByName(without_id.mapInArrow(whole, kinds))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_repeats()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
