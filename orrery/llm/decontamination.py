"""Benchmark decontamination: Wu-Manber search of all documents for word windows of benchmark items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filtered, materialize, text_chunks

#: Everything but 0-9, a-z (after lower-casing) and bytes of non-ASCII characters parts words.
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
#: Bytes of windows that one search table is built from, and of texts that wait while the tables of several shards are built in turn. They bound what a task holds.
SHARD_BYTES, WAITING_BYTES = 4 << 20, 32 << 20


def bench_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z and take words of digits, letters a-z and non-ASCII characters."""
    return text.lower().translate(_SPACES).split()


class WuManber:
    """Search for word sequences of one length m.

    Blocks of B words (2, or 1 if m is 1) stand in a shift table: how far the window's end may move when it stands on that
    block. Shift 0 leads to the bucket of windows that end with this block; of those, the ones whose first word agrees are
    compared whole.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], int], m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(dict))
        for words, number in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.bucket[words[m - self.block :]][words[0]][words] = number

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Places and numbers of the windows that occur."""
        m, shift, most = self.m, self.shift, self.most
        at, n = m, len(words)
        two = self.block == 2
        while at <= n:
            key = (words[at - 2], words[at - 1]) if two else (words[at - 1],)
            step = shift.get(key, most)
            if step:
                at += step
                continue
            same = self.bucket[key].get(words[at - m])
            if same:
                number = same.get(tuple(words[at - m : at]))
                if number is not None:
                    yield at - m, number
            at += 1


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, text) -> item_id, m, window: each run of width words (all words of a shorter item), joined by one space, with its number of words m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                for k, text in enumerate(texts):
                    words = bench_words(text)
                    m = min(width, len(words))
                    for low in range(0, len(words) - m + 1 if m else 0, 10_000):
                        found = [b" ".join(words[i : i + m]).decode() for i in range(low, min(low + 10_000, len(words) - m + 1))]
                        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array([k] * len(found))), pa.array([m] * len(found), pa.int32()), pa.array(found)], names=["item_id", "m", "window"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, m int, window string")


def numbered_windows(found: DataFrame) -> DataFrame:
    """Distinct windows of item_windows() with a number each, as a table."""
    return materialize(found.groupBy("m", "window").agg(F.count(F.lit(1)).alias("n")).select("m", "window", F.monotonically_increasing_id().alias("number")))


def window_shards(windows: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[Broadcast]:
    """Numbered windows dealt by their hash to broadcasts of about shard_bytes, made one after the other. There is one at least."""
    total = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    sc = windows.sparkSession.sparkContext
    sent = []
    for k in range(n):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).select("m", "window", "number").toArrow()
        sent.append(sc.broadcast(rows))
    return sent


def _tables(sent: Broadcast) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(dict)
    rows = sent.value
    for m, window, number in zip(*(rows.column(c).to_pylist() for c in ("m", "window", "number")), strict=True):
        by_length[m][tuple(window.encode().split(b" "))] = number
    if getattr(sent, "_path", None):  # a worker reads its broadcasts from files: this one again when its turn comes
        sent.__dict__.pop("_value", None)
    return [WuManber(windows, m) for m, windows in by_length.items()]


def _searched(batches: Iterator[pa.RecordBatch], shards: list[Broadcast], look: Callable, waiting_bytes: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches, with a list a text of what look(tables, words) gives for each shard.

    With one shard the tables stay. With more, texts wait until there are waiting_bytes of them and each shard's tables are built, used for all of them and dropped.
    """

    def done(parts: list) -> Iterator[tuple[pa.RecordBatch, list]]:
        found: list[list[list]] = [[[] for _ in texts] for _, texts in parts]
        for shard in shards:
            tables = kept or _tables(shard)
            for rows, (_, texts) in zip(found, parts, strict=True):
                for row, text in zip(rows, texts, strict=True):
                    row.append(look(tables, bench_words(text)))
        for rows, (part, _) in zip(found, parts, strict=True):
            yield part, rows

    kept = _tables(shards[0]) if len(shards) == 1 else None
    parts, size = [], 0
    for batch in batches:
        for part, texts in text_chunks(batch):
            parts.append((part, texts))
            size += sum(map(len, texts))
            if kept or size >= waiting_bytes:
                yield from done(parts)
                parts, size = [], 0
    yield from done(parts)


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10, shard_bytes: int = SHARD_BYTES, waiting_bytes: int = WAITING_BYTES) -> DataFrame:
    """Rows of docs (text and any others) in which no window of an item occurs, unchanged.

    Null, empty and blank texts are clean. Texts of any length pass whole and aren't shuffled. Items are as in search(); without items all rows stay.
    """
    windows = numbered_windows(item_windows(items, width))
    shards = window_shards(windows, shard_bytes)
    discard(windows)
    look = lambda tables, words: any(next(t.find(words), None) for t in tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _searched(batches, shards, look, waiting_bytes):
            yield part.filter(pa.array([not any(r) for r in rows], pa.bool_()))

    return filtered(docs, run)


def search(docs: DataFrame, items: DataFrame, width: int = 10, shard_bytes: int = SHARD_BYTES, waiting_bytes: int = WAITING_BYTES) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, n_words, hits (word spans, merged), items (ids with occurring windows, sorted).

    Windows of the items become a table of distinct ones. They go to the searchers in shards of about shard_bytes; documents are read once, whatever the number
    of shards, and texts aren't shuffled. What a document has is the numbers of its windows; the items of these are found by a join, as a window may
    stand in very many items.

    Null, empty and blank texts have no words and no hits; texts may be of any length. Items without words match nothing. An item without an id marks words but isn't listed.
    Repeated rows of documents count each; items with equal ids are one item. Without items nothing is hit; no documents give no rows. Other columns don't matter.
    """
    of_items = materialize(item_windows(items, width))
    windows = numbered_windows(of_items)
    shards = window_shards(windows, shard_bytes)

    def look(tables: list[WuManber], words: list[bytes]) -> tuple:
        return len(words), [(at, at + t.m, number) for t in tables for at, number in t.find(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _searched(batches, shards, look, waiting_bytes):
            n, hits, numbers = [], [], []
            for row in rows:
                n.append(row[0][0])
                spans = sorted(s for _, found in row for s in found)
                merged: list[dict] = []
                for a, b, _ in spans:
                    if merged and merged[-1]["stop"] >= a:
                        merged[-1]["stop"] = max(merged[-1]["stop"], b)
                    else:
                        merged.append({"start": a, "stop": b})
                hits.append(merged)
                numbers.append(sorted({k for _, _, k in spans}))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(numbers, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "hits", "numbers"],
            )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, hits array<struct<start: int, stop: int>>, numbers array<long>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))  # a table: from here on a row's number stays
    owners = materialize(of_items.where("item_id IS NOT NULL").join(windows, ["m", "window"]).select("number", "item_id").distinct())
    discard(of_items)
    discard(windows)
    listed = found.select("row", F.explode("numbers").alias("number")).join(owners, "number").select("row", "item_id").distinct()
    listed = materialize(listed.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    none = F.array().cast(listed.schema["items"].dataType)
    return found.join(listed, "row", "left").select("doc_id", "n_words", "hits", F.coalesce("items", none).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """Digest of search(): counts, the hash of the item ids sorted as strings, and the verdict."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: DuckDB SQL for report(): windows of items joined with windows of documents of the same length.
REPORT_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {documents}),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iv AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)),
dv AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM iv) WHERE len(w) >= m)),
h AS (SELECT dv.r, dv.i, dv.m, iv.item_id FROM dv JOIN iv USING (m, s)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY r)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
