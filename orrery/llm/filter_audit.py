"""What filters do to each other: what each one removes, in every order, from sorted lists of the documents that fail it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: log2 of the ids a range: a task merges the lists of one range at a time.
RANGE_BITS = 16


# ---- sorted lists ----


def gallop(ids: list[int], x: int, low: int) -> int:
    """The first place from low on whose id is at least x: doubling steps, then bisection of the last of them."""
    high, step = low, 1
    while high < len(ids) and ids[high] < x:
        low, high, step = high + 1, high + step, step * 2
    return bisect_left(ids, x, low, min(high, len(ids)))


def union(lists: Sequence[list[int]]) -> list[int]:
    """Ids of any list, in order: the list with the smallest head gives all it has up to the next list's head."""
    found: list[int] = []
    live = [[ids, 0] for ids in lists if ids]
    while len(live) > 1:
        live.sort(key=lambda x: x[0][x[1]])
        first, limit = live[0], live[1][0][live[1][1]]
        end = gallop(first[0], limit, first[1])
        found += first[0][first[1] : end]
        first[1] = end + (end < len(first[0]) and first[0][end] == limit)  # the next list gives it
        if first[1] == len(first[0]):
            live.pop(0)
    for ids, at in live:
        found += ids[at:]
    return found


def difference(ids: list[int], others: Sequence[list[int]]) -> list[int]:
    """Ids that none of the other lists has: runs up to the smallest of the others' heads, which gallop after."""
    found: list[int] = []
    at, live = 0, [[other, 0] for other in others if other]
    while at < len(ids) and live:
        for x in live:
            x[1] = gallop(x[0], ids[at], x[1])
        live = [x for x in live if x[1] < len(x[0])]
        if not live:
            break
        head = min(x[0][x[1]] for x in live)
        end = gallop(ids, head, at)
        found += ids[at:end]
        at = end + (end < len(ids) and ids[end] == head)
    return found + ids[at:]


def common(ids: list[int], others: list[int]) -> int:
    """How many ids both lists have; the shorter one leads."""
    if len(ids) > len(others):
        ids, others = others, ids
    n = at = 0
    for x in ids:
        at = gallop(others, x, at)
        n += at < len(others) and others[at] == x
    return n


# ---- documents ----


def document_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) -> doc_id, part, and whether the text fails each filter: A short, B repetitive, C shouting, D symbols, E a copy of a smaller id's text.

    A is under 50 words, B under 65 % distinct ones, C over 5 % capitals, D any of #$%&*|. Null text is empty, a null source the part "". A null id is neither a copy nor an original.
    Texts meet by a hash of 256 bits, in a table that Spark may split where a text has many copies.
    """
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    failing = [
        (n < 50).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 65 * n.cast("long")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    ]
    judged = materialize(worded.select("doc_id", "part", F.sha2("text", 256).alias("text_key"), *failing))
    copied = materialize(judged.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("text_key", "first"))
    found = materialize(judged.join(copied, "text_key", "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")))
    discard(judged)
    discard(copied)
    return found


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether labels (doc_id, quality, toxic) has a 1 for the id. Ids labelled twice have either's labels; a null id has none."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = materialize(labels.groupBy("doc_id").agg(one("quality"), one("toxic")).where("quality OR toxic"))
    no = F.lit(False)
    return rows.join(marked, "doc_id", "left").select(*rows.columns, F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def postings(rows: DataFrame, filters: str = FILTERS, range_bits: int = RANGE_BITS) -> DataFrame:
    """(part, a boolean a filter, good, toxic) -> part, range, n (rows), and sorted lists of row numbers: one a filter, good, toxic.

    Rows are numbered first, so that repeated ids count each; a range has 2^range_bits numbers at most, and so a hot part has many lists, none of them longer.
    """
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    # as many partitions as a shuffle has, however small the lists: merging them is the work
    dealt = numbered.withColumn("range", F.shiftright("row", range_bits)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "range")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c)
    return dealt.groupBy("part", "range").agg(F.count(F.lit(1)).alias("n"), *(listed(c) for c in (*filters, "good", "toxic")))


def _merge(filters: str):
    """A function of batches of postings: for each part, filter and set of filters before it, sizes of the merged lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(f, "".join(s)) for f in filters for k in range(len(filters)) for s in combinations(filters.replace(f, ""), k)]
        schema = pa.schema([("part", pa.string()), ("filter", pa.string()), ("before", pa.string()), *((c, pa.int64()) for c in ("n", "gone", "removed", "good_lost", "toxic_lost"))])
        for batch in batches:
            sizes: dict[str, np.ndarray] = {}
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = {c: row.column(c)[0].values.to_pylist() for c in (*filters, "good", "toxic")}
                gone: dict[str, int] = {}
                mine = np.zeros((len(sets), 5), dtype=np.int64)
                for k, (f, before) in enumerate(sets):
                    both = "".join(sorted(before + f))
                    if both not in gone:
                        gone[both] = len(union([ids[c] for c in both]))
                    removed = difference(ids[f], [ids[c] for c in before])
                    mine[k] = row.column("n")[0].as_py(), gone[both], len(removed), common(removed, ids["good"]), common(removed, ids["toxic"])
                part = row.column("part")[0].as_py()
                sizes[part] = sizes.get(part, 0) + mine
            columns = [pa.array([p for p in sizes for _ in sets], pa.string()), *(pa.array([s[i] for _ in sizes for s in sets], pa.string()) for i in (0, 1))]
            table = np.concatenate(list(sizes.values())) if sizes else np.zeros((0, 5), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in table.T.copy())], schema=schema)

    return run


def interactions(listed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """postings() -> part, filter, before (the filters applied earlier, sorted), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A range's lists are merged by themselves and only sizes are summed. What a step does depends on the set of filters before it, not on their order: five filters have 80
    such steps, not 600. shapley weighs each with the number of orders that have it.
    """
    made = listed.mapInArrow(_merge(filters), "part string, filter string, before string, n long, gone long, removed long, good_lost long, toxic_lost long")
    total = made.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("n", "gone", "removed", "good_lost", "toxic_lost")))
    same = Window.partitionBy("part", "filter")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(filters) - 1 - k)) for k in range(len(filters)))), F.length("before") + 1).cast("long")
    when = lambda size: F.max(F.when(F.length("before") == size, F.col("removed"))).over(same)
    return total.select(
        "part", "filter", "before", (F.col("n") - F.col("gone")).alias("kept"), "removed", (when(0) - F.col("removed")).alias("redundant"), when(len(filters) - 1).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum(F.col("removed") * orders).over(same).alias("shapley"),
    )


def in_every_order(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """interactions() -> the same figures for each filter_order and step (from 1), filters named by one letter each."""
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    fits: Column = F.filter(orders, lambda o: (F.substring(o, F.length("before") + 1, F.lit(1)) == F.col("filter")) & (F.array_join(F.array_sort(F.split(F.substring(o, F.lit(1), F.length("before")), "")), "") == F.col("before")))
    return found.select("part", F.explode(fits).alias("filter_order"), (F.length("before") + 1).cast("int").alias("step"), *(c for c in found.columns if c not in ("part", "filter", "before")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents and labels -> a row a part, order of the five filters and step, with zeros: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null, empty and very long texts are judged whole; repeated rows count each. Labels without a document don't matter. No documents give no rows; without labels nothing good or
    toxic is lost. Other columns of docs and labels don't matter, whatever their names.
    """
    marked = with_labels(document_filters(docs.select("doc_id", "text", "source")), labels.select("doc_id", "quality", "toxic"))
    listed = postings(marked)
    discard(marked)
    found = materialize(interactions(listed))
    discard(listed)
    return in_every_order(found)


#: DuckDB SQL for audit(): counts by the set of failed filters, met with all orders and steps.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM {documents}),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
             coalesce(list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65))::INT)), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, letter,
             coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(n * good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
