"""Fill-in-middle: texts cut into prefix, middle and suffix at token edges and put in the order in which a model learns to fill the gap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token with the white space before it, or white space that ends a text. Possessive, as its two classes share no character: nothing is tried twice.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Out of a hundred texts, how many stay plain from, and how many of the others have the suffix first.
PLAIN_FROM, SPM_BELOW = 50, 80


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever texts without them stand around: no marker holds its own or another's first character later on."""
    firsts = {m[:1] for m in markers}
    if len(set(markers)) < 3 or "" in markers or any(f in m[1:] for m in markers for f in firsts) or any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError("markers must differ, and the character that one begins with mustn't occur again in any")


def _draw(doc_id: str, seed: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of a keyed hash of the id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "42", markers: tuple[str, str, str] = MARKERS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, text) -> all columns, text as the model gets it, and n_tokens, form ("plain", "psm" or "spm"), prefix_chars, middle_chars (null if plain).

    A text has n tokens. Two hashes of its id, modulo n + 1, are the cuts: a, the smaller, and b. One match of a pattern made for the row finds the parts, as it counts
    a tokens and then b - a by possessive quantifiers, which keep no state to come back to: time and stack don't depend on n. Everything is a column expression of one
    row, so that there is no shuffle, and a lost executor costs its tasks.

    A null or empty text is empty and plain; so are texts that hold a marker, unchanged. White space alone is one token. Equal ids have equal draws, also a null one;
    repeated rows repeat. No rows give no rows. Columns named as the new ones give way; others stay, whatever their names.
    """
    _check(markers)
    held = F.lit(False)
    for m in markers:
        held = held | F.contains(F.col("whole"), F.lit(m))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    read = docs.select(doc.alias("doc"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("whole"))
    counted = read.select("doc", "whole", F.regexp_count("whole", F.lit(UNIT)).cast("long").alias("n"), *(_draw("id", seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    plain = (F.col("whole") == "") | (F.col("h3") % 100 >= plain_from) | held
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    formed = counted.select("doc", "whole", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    group = lambda count: F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    p, s, m = (x.replace("\\", "\\\\").replace("$", "\\$") for x in markers)
    order = F.when(F.col("form") == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    written = formed.select("doc", "n", "form", F.when(F.col("form") == "plain", F.col("whole")).otherwise(F.regexp_replace("whole", pattern, order)).alias("out"))
    # a marker's first character never occurs within it again, so that its first place is the right one
    at = [F.instr("out", F.lit(x)) for x in markers]
    chars = lambda here, k, to: F.when(F.col("form") == "plain", F.lit(None)).otherwise(to - here - len(markers[k])).cast("long")
    prefix = chars(at[0], 0, F.when(F.col("form") == "spm", at[2]).otherwise(at[1]))
    added = {"n_tokens": F.col("n"), "form": F.col("form"), "prefix_chars": prefix, "middle_chars": chars(at[2], 2, F.length("out") + 1)}
    columns = [F.col("out").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in added]
    return written.select(*columns, *(v.alias(k) for k, v in added.items()))


def restored(text: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that fill_in_middle() was given, from its output and form (a null text comes back as an empty one)."""
    _check(markers)
    p, s, m = (re.escape(x) for x in markers)
    psm = F.regexp_replace(text, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(text, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def digest(cut: DataFrame) -> DataFrame:
    """fill_in_middle() -> doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("text")).alias("output_sha256"), sha(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for the digest of fill_in_middle(): lists of tokens, cut and joined.
FILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM {documents}),
e AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p
"""
