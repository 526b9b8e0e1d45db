import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, `a.b` int, form string"


def by_hand(doc_id, text):
    t = text or ""
    u = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, t
    spm = h4 % 100 < 80
    return len(u), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "bc", "été", "\U0001f642x", "<", "<P", "S>", "$1", "\\", "\x1c", " ", "\u0085", " ", "  ", "\t", "\n", "\r\n", "\x0b"])
    some = [None, "", " ", "\n\n", "x", "<P>x y", "a <S>", "<M", "$1 \\ $2 <M $0"] + ["".join(piece() for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(some)] + [(None, "no id here"), (None, None), (7, "the same id"), (7, "the same id"), (-5, "below zero id")]


def test_parts_equal_those_by_hand(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "old") for i, t in rows], SCHEMA)
    got = fill_middle.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_tokens", "form", "prefix_chars", "middle_chars"]
    found = got.withColumn("back", fill_middle.restored(F.col("text"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.text, r.back) for r in found), key=key) == sorted(((i, *by_hand(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_long_texts_take_no_stack(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word \n"), 500_000).alias("text"))
    blank = spark.range(8, 16).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" "), 2_000_000).alias("text"))
    single = spark.range(16, 24).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 2_000_000).alias("text"))
    rows = fill_middle.digest(fill_middle.fill_in_middle(docs.union(blank).union(single))).collect()
    want = [hashlib.sha256(t.encode()).hexdigest() for t in ("word \n" * 500_000, " " * 2_000_000, "x" * 2_000_000)]
    assert all(r.restored_sha256 == want[r.doc_id // 8] and r.n == (500_001, 1, 1)[r.doc_id // 8] for r in rows) and len(rows) == 24


def test_other_markers_and_no_rows(spark):
    docs = spark.createDataFrame([(i, f"one two {i} three <P> four") for i in range(40)], "doc_id long, text string")
    cut = fill_middle.fill_in_middle(docs, seed="s", markers=("[$", "{\\", "(^"), plain_from=100, spm_below=50)
    back = cut.select("doc_id", "form", fill_middle.restored(F.col("text"), F.col("form"), ("[$", "{\\", "(^")).alias("t")).collect()
    assert all(r.t == f"one two {r.doc_id} three <P> four" for r in back) and {r.form for r in back} == {"psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<<", "a", "b"), ("", "a", "b"), ("a", "ab", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, markers=bad)


def test_draws_need_no_exchange(spark, capsys):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").transform(fill_middle.fill_in_middle).explain()
    assert "Exchange" not in capsys.readouterr().out
