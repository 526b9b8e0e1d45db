"""Cross-site boilerplate: lines that many sites share are removed, after their first document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch; its relative standard error is 1.04 / sqrt(2^LG_K), 3.3 % here.
LG_K = 10
#: Standard errors around the threshold within which sites are counted exactly.
SIGMAS = 6


def line_key(line: Column) -> Column:
    """Two 64-bit hashes of a trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(key, site, doc_id) a line -> key, first_doc, n_sites of the lines on at least min_sites sites.

    Sketches of the sites merge by aggregation, on the map side too, so a line of any frequency is a row a task. Estimates
    clear of the threshold by SIGMAS standard errors decide; the lines between get an exact distinct count. What lines join is a table,
    and so is what comes of it: such a join is one that Spark may split where a line is frequent.
    """
    error = SIGMAS * 1.04 / 2 ** (lg_k / 2)
    sketched = materialize(
        lines.groupBy("key")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)  # a line has as many sites as rows at most
        .withColumn("estimate", F.hll_sketch_estimate("sketch"))
        .where(F.col("estimate") >= min_sites / (1 + error))
        .select("key", "first_doc", "estimate")
    )
    sure = sketched.where(F.col("estimate") > min_sites * (1 + error)).select("key", "first_doc", F.col("estimate").alias("n_sites"))
    near = sketched.where(F.col("estimate") <= min_sites * (1 + error))
    met = materialize(lines.select("key", "site").join(near.select("key", "first_doc"), "key"))
    exact = met.distinct().groupBy("key", "first_doc").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    found = materialize(sure.unionByName(exact))
    discard(sketched)
    discard(met)
    return found


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with doc_id, text and a site column -> the same columns, with text rid of boilerplate, and n_lines, n_removed (columns of these names give way).

    Lines are parted by \\n and compared after trimming spaces; blank ones stay. A boilerplate line stays in the document
    with the smallest id that has it (all its occurrences there). A null site is a site. Null text stays null with no lines; an empty text is one blank line. A
    null id is never the first while another exists. All documents stay, also those left with no line. Rows may repeat: those with equal id and text share
    what they lose, and none with an id loses the lines of which it is the first. Texts of any number of lines take time in proportion to it. No rows give no rows.
    Columns of any other name may stand beside these.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.trim("line") != "").select("doc_id", "text_key", "site", "at", line_key(F.col("line")).alias("key"))
    bad = boilerplate_lines(lines, min_sites)
    # the places that each document loses
    lost = lines.drop("site").join(bad.select("key", "first_doc"), "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    lost = materialize(lost.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("gone")))
    discard(bad)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    joined = whole.join(lost, F.col("id").eqNullSafe(F.col("doc_id")) & (whole["text_key"] == lost["text_key"]), "left").select("doc", "gone")
    text, gone = F.col("doc.text"), F.col("gone")
    cleaned = F.when(gone.isNull(), text).otherwise(let(F.struct(F.split(text, "\n").alias("parts"), gone.alias("gone")), _without))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    columns = [cleaned.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, n_lines.alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))


def _without(s: Column) -> Column:
    """The parts joined again, but for those in the places gone: the stretches between these."""
    start = lambda j: F.when(j == 0, 0).otherwise(F.get(s["gone"], j - 1) + 1)
    stop = lambda j: F.coalesce(F.get(s["gone"], j), F.size(s["parts"]))
    stretches = F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda j: F.slice(s["parts"], start(j) + 1, stop(j) - start(j)))
    return F.array_join(F.flatten(stretches), "\n")


#: DuckDB SQL for the digest of remove_boilerplate().
LINES_SQL = r"""
WITH l AS (SELECT doc_id, coalesce('s' || source, '') AS site, trim(x) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM {documents}) WHERE trim(x) <> ''),
bad AS (SELECT line, min(doc_id) AS first_doc FROM l GROUP BY line HAVING count(DISTINCT site) >= 10),
kept AS (SELECT d.doc_id, d.text, list_filter(p.parts, lambda x: NOT list_contains(p.gone, trim(x))) AS keep, p.parts
         FROM {documents} d JOIN (SELECT d.doc_id, string_split(d.text, chr(10)) AS parts, coalesce(g.gone, []) AS gone
              FROM {documents} d LEFT JOIN (SELECT l.doc_id, list(DISTINCT l.line) AS gone FROM l JOIN bad USING (line) WHERE l.doc_id <> bad.first_doc GROUP BY l.doc_id) g USING (doc_id)) p USING (doc_id))
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(keep), 0)::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(keep, chr(10))) END AS text_sha256 FROM kept
"""
