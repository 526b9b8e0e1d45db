import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import line_dedup, near_dedup, substring_dedup
from orrery.llm.common import Words, text_chunks

WORDS = [f"w{i}" for i in range(3000)]


def _sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_word_hashes_tell_words_apart():
    texts = [b"one two  three\tone", b"", b"three\x0bone", b" two", " x　".encode()]
    words = Words(texts)
    got = [words.hash[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:])]
    assert [len(g) for g in got] == [len(t.split()) for t in texts]
    assert got[0][0] == got[0][3] == got[2][1] and got[0][1] == got[3][0] and len({*got[0], *got[4]}) == 4
    grams = Words([b"a b c d", b"x a b c"]).grams(3)
    assert grams[0] == grams[5] and grams[1] != grams[0]


def test_chunks_cover_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * (3 << 20), None, "b", "", "c" * (1 << 20)])], names=["id", "text"])
    parts = list(text_chunks(batch))
    assert sum((p.column("id").to_pylist() for p, _ in parts), []) == list(range(5)) and len(parts) == 2


# ---- lines ----


def _lines_by_hand(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            sites[line].add(site)
            if i is not None:
                first[line] = min(i, first.get(line, i))
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        kept = [x for x in text.split("\n") if not (len(sites[x.strip(" ")]) >= least and x.strip(" ") and first.get(x.strip(" ")) != i)]
        out.append((i, "\n".join(kept)))
    return out


def test_lines(spark):
    rng = random.Random(1)
    common = ["all rights reserved", "near the threshold", "under it"]
    rows = []
    for i in range(60):
        lines = [_sentence(rng, 4) for _ in range(3)] + [common[0]] + ([common[1] + " "] if i < 10 else []) + ([common[2]] if i < 9 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n", None), (103, common[0], None), (104, common[0] + "\n" + common[0], "s3")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_lines int, lost int")
    found = line_dedup.remove_boilerplate(docs)
    assert found.columns == ["doc_id", "text", "source", "lost", "n_lines", "n_removed"]
    assert {(r.doc_id, r.text) for r in found.collect()} == set(_lines_by_hand(rows, 10))
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_exact_counts_near_the_threshold(spark):
    rows = [("k", f"s{s}", d) for d, s in enumerate([*range(10), 3, 3])] + [("m", f"s{s}", 50 + s) for s in range(9)] + [("n", f"s{s}", 90 + s) for s in range(400)]
    lines = spark.createDataFrame(rows, "key string, site string, doc_id long")
    found = {r["key"]: (r.first_doc, r.n_sites) for r in line_dedup.boilerplate_lines(lines, 10).collect()}
    assert set(found) == {"k", "n"} and found["k"] == (0, 10) and abs(found["n"][1] - 400) < 60


# ---- near duplicates ----


def test_signatures_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(5)
    n, k = 300, 400
    x = rng.integers(0, 2**63, size=n, dtype=np.uint64)
    wa, wb = rng.choice([0.25, 1, 2.5, 3], size=n), rng.choice([0.25, 1, 2.5, 3], size=n)
    doc = np.repeat([0, 1, 2], [n, n, 1])
    sig = near_dedup.dart_minhash(doc, np.concatenate([x, x, x[:1]]), np.concatenate([wa, wb, [1.0]]), 4, k)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / k)
    assert (sig[:3] != 0).all() and (sig[3] == 0).all()


def _classes_by_hand(rows, least=0.8):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = _sentence(rng, 30 + 15 * g).split()
        for _ in range(7):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", None, "two words", "two words", "two  words", "w1"])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == _classes_by_hand(rows)
    kept = {r.doc_id for r in near_dedup.keep_first(docs.unionByName(docs)).collect()}
    assert kept == set(found.values())
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_whose_members_differ(spark):
    rng = random.Random(9)
    base = _sentence(rng, 60).split()
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == _classes_by_hand(rows)


# ---- repeated passages ----


def _removed_by_hand(rows, window=50):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        spans = [tuple(w[p : p + window]) for p in range(len(w) - window + 1)]
        gone = {p + k for p, s in enumerate(spans) if first.get(s, i) < i for k in range(window)}
        for s in spans:
            first.setdefault(s, i)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages(spark):
    rng = random.Random(4)
    passages = [_sentence(rng, n) for n in (49, 50, 51, 90, 200)]
    rows = []
    for i in range(40):
        parts = [_sentence(rng, rng.randint(0, 40)) for _ in range(4)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        rows.append((i * 3 % 41, "  ".join(parts)))
    whole = _sentence(rng, 300)
    rows += [(200, whole), (201, whole), (202, whole + " " + whole), (203, " ".join(["same"] * 120)), (204, " ".join(["same"] * 75)), (205, None), (206, ""), (207, "short")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    found = substring_dedup.digest(substring_dedup.remove_repeats(docs, shard_bytes=4000))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == _removed_by_hand(rows)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_null_ids_keep_all(spark):
    text = " ".join(WORDS[:80])
    docs = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in substring_dedup.remove_repeats(docs).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_rows_of_one_id_or_none_are_in_many_tasks(spark):
    rng = random.Random(8)
    passage, own = _sentence(rng, 60), _sentence(rng, 55)
    first = spark.createDataFrame([(1, passage), (2, f"before {passage} after"), (9, f"again {own}")], "doc_id long, text string")
    none = spark.range(100_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(passage).alias("text"))
    same = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit(f"{passage} "), F.when(F.col("id") % 2 == 0, F.lit(own)).otherwise("")).alias("text"))
    found = substring_dedup.remove_repeats(first.union(same).union(none), shard_bytes=20_000).withColumn("task", F.spark_partition_id()).cache()
    assert found.count() == 100_603
    for which in ("doc_id IS NULL", "doc_id = 7"):
        rows = found.where(which)
        assert rows.select("task").distinct().count() > 1 and rows.groupBy("task").count().agg(F.max("count")).first()[0] < 0.8 * rows.count()
    assert found.where("doc_id IS NULL AND size(spans) > 0").count() == 0
    kept = {(r.doc_id, r.kept_text) for r in found.where("doc_id IS NOT NULL").select("doc_id", "kept_text").distinct().collect()}
    assert kept == {(1, passage), (2, "before after"), (7, own), (7, ""), (9, "again")}


def test_lines_of_long_and_repeated_rows(spark):
    common = [f"common {k}" for k in range(300)]
    long = "\n".join(x for k in range(3000) for x in (common[k % 300], f"own {k}"))
    rows = [(i, "\n".join(common), f"s{i}") for i in range(12)] + [(50, long, "s1"), (51, long, "s1"), (51, long, "s1"), (51, common[3], "s9"), (None, common[4], "s2"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, gone int, doc int")
    found = line_dedup.remove_boilerplate(docs)
    shown = lambda i, t: (-1 if i is None else i, t or "")
    assert sorted(shown(r.doc_id, r.text) for r in found.collect()) == sorted(shown(i, t) for i, t in _lines_by_hand(rows, 10))
    assert found.where("n_removed <> 3000 AND doc_id = 50").count() == 0 and found.columns == [*docs.columns, "n_lines", "n_removed"]


def test_rows_with_equal_id_are_told_apart(spark):
    text = _sentence(random.Random(7), 40)
    rows = [(1, "one text"), (1, "another text"), (1, "one text"), (2, "another text"), (3, text), (4, text + " more"), (5, None), (5, None), (6, ""), (None, "one text"), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").withColumnRenamed("place", "label")
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.label) for r in kept.collect()) == [(0, "", 10), (0, "one text", 9), (1, "another text", 1), (1, "one text", 0), (3, text, 4), (5, "", 6), (6, "", 8)]
    classes = sorted((r.doc_id or 0, r.class_id or 0) for r in near_dedup.near_duplicates(docs).collect())
    assert classes == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (6, 6)]


def test_buckets_of_unlike_texts_lose_no_link(spark, monkeypatch):
    # texts that share two thirds: they meet in bands, and blocks are small
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    rng = random.Random(12)
    base = _sentence(rng, 90).split()
    rows = []
    for i in range(90):
        own = base[:60] + _sentence(random.Random(100 + i // 2), 30 - 12 * (i % 3 == 0)).split()
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    want = _classes_by_hand(rows)
    assert sum(got[i] != want[i] for i in got) <= 1  # a pair of exactly the threshold may share no band


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").split())}
    where = defaultdict(list)
    for i in sorted(sets):
        for x in sets[i]:
            where[x].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)
    # and no class but by links
    label = {i: i for i in got}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        p, q = root(a), root(b)
        label[max(p, q)] = min(p, q)
    assert got == {i: root(i) for i in got}
    found = substring_dedup.digest(substring_dedup.remove_repeats(docs))
    want = _removed_by_hand([(i, None if t is None else t) for i, t in rows])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == want


def test_slices_have_all_windows_once(spark, monkeypatch):
    rng = random.Random(3)
    for text in (_sentence(rng, 900), " " * 700 + "a " * 400, "x" * 5000 + " y z", "", " \t\n " * 300, ("long" * 300 + " ") * 70):
        words = text.encode().split()
        starts = []
        for number, piece in substring_dedup.slices(text.encode(), 600, 49):
            got = piece.split()
            assert got == words[number : number + len(got)]
            starts += range(number, number + max(len(got) - 49, 0))
        assert starts == list(range(max(len(words) - 49, 0)))
    # texts cut at different places still find what they share, and equal ids don't remove from each other
    shared = _sentence(rng, 700)
    rows = [(1, _sentence(rng, 333) + " " + shared), (2, shared + " " + _sentence(rng, 200)), (3, _sentence(rng, 10) + " " + shared), (3, shared), (3, _sentence(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.n_words): r.kept_text for r in substring_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(substring_dedup.segments, "__defaults__", (50, 900))
    monkeypatch.setattr(substring_dedup, "text_chunks", lambda batch: ((batch.slice(k, 1), [(t or "").encode()]) for k, t in enumerate(batch.column("text").to_pylist())))
    cut = {(r.doc_id, r.n_words): r.kept_text for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut == whole and [len(v.split()) for _, v in sorted(cut.items())] == [1033, 200, 60, 0, 10]
