"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target: sources by code point, null last, weigh 1, 2, 3, repeating; a target stops at
    cap times its source's size and the excess goes to the others by weight.

    That fixed point is a water level: targets are least(cap * size, level * weight), and the level follows from one pass
    over the sources in the order of cap * size / weight. One row a source; documents never come here. The sources stand in order in one task: some millions of them,
    as of hosts, are some tens of MB there.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        # the level if this source and all after it stay under their caps; the first of them that holds is the level, and the highest
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("water", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return filled.select("source", "source_size", F.round(target, 4).alias("target"))


def mix(docs: DataFrame, cap: float = 3.0, seed: str = "orrery", shards: int = 256, carry: bool = False) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken; with carry also doc, the whole row as a struct.

    Within a source, documents stand in the order of size and of a keyed hash; each expects target / source_size copies.
    Prefix sums of these, plus one random offset a source, give a document one copy for each integer that its step crosses.
    As all documents of a source expect the same, the prefix sum is a rank times that figure. The rank comes from counts of
    (source, size, hash shard) and a row number within such a shard, so that a hot source is ranked in many tasks.

    Null text has size 0, and so have empty and blank ones; words of texts of any length are all counted. Null is a source of its own. Rows may repeat; each is a document. Ties in the order are between
    rows with equal id, whose results are then the same up to their exchange. No rows give no rows. Other columns don't matter.
    """
    digits = max(1, len(f"{shards - 1:x}"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    with_row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    rows = docs.select("doc_id", "source", n_words().alias("size"), key.alias("key"), *with_row).withColumn("shard", F.substring("key", 1, digits))
    counts = rows.groupBy("source", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n_size"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size"))
    targets = source_targets(totals, cap)
    before_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before_shard = Window.partitionBy("source", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n_size").over(before_size), F.lit(0)).alias("smaller"))
    shards_ = counts.select("source", "size", "shard", F.coalesce(F.sum("n").over(before_shard), F.lit(0)).alias("earlier"))
    offsets = shards_.alias("h").join(sizes.alias("z"), [F.col("h.source").eqNullSafe(F.col("z.source")), F.col("h.size") == F.col("z.size")]).select(
        F.col("h.source").alias("source"), F.col("h.size").alias("size"), F.col("h.shard").alias("shard"), (F.col("earlier") + F.col("smaller")).alias("before")
    )
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target")
    within = Window.partitionBy("source", "size", "shard").orderBy("key", "doc_id")
    ranked = rows.withColumn("place", F.row_number().over(within))
    a, b = ranked.alias("a"), offsets.alias("b")
    both = a.join(b, [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.size") == F.col("b.size"), F.col("a.shard") == F.col("b.shard")]).select(
        "a.doc_id", "a.source", "a.size", "b.source_size", "b.target", (F.col("b.before") + F.col("a.place")).alias("rank"), *(["a.doc"] if carry else [])
    )
    # a grid of 2^-10 keeps offset + rank * 3 exact, so that a source at its cap gives three copies each
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("long") % 1024 / 1024.0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    copies = (F.floor(F.col("rank") * rate + u) - F.floor((F.col("rank") - 1) * rate + u)).cast("long")
    copies = F.least(copies, F.lit(int(cap)).cast("long"))
    return both.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["doc"] if carry else []))


def mixed_documents(docs: DataFrame, cap: float = 3.0, seed: str = "orrery") -> DataFrame:
    """The mix itself: each document once for each of its copies, with the copy's number (a column named copy gives way).

    What becomes of nulls, empty texts and repeated rows is as in mix(); documents without copies go. Other columns stay, whatever their names.
    """
    taken = mix(docs, cap, seed, carry=True).where("copies > 0")
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


#: DuckDB SQL for the same rows.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('orrery:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, round(least(most, coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most)), 4) AS target FROM l),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, key, doc_id) AS rank FROM d),
c AS (SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.rank,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
             (('0x' || substr(md5('orrery:' || coalesce(r.source, '')), 1, 4))::BIGINT % 1024)::DOUBLE / 1024.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, least((floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT, 3) AS copies FROM c)
"""
