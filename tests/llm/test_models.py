"""Trained operators and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import language, learning, mixing, quality, toxicity

from .test_dedup import _lines_by_hand
from .test_filters import _corpus, _targets_by_hand, _words

D = "/root/testdata/sf0.001"


def test_toxicity_scores_by_plain_search(spark):
    rng = random.Random(4)
    words = ["trash", "trashy", "moron", "morons", "can", "idiot", "the", "a", "im", "mor"]
    disguise = {"a": "а@4", "o": "о0", "i": "1і", "s": "$5"}
    texts = [" ".join("".join(rng.choice(disguise.get(c, c) + c) for c in rng.choice(words)) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", " ", "trash " * 30_000]
    lexicon = toxicity.Lexicon({" trash ": 5.0, " moro": 4.0, " idiot ": 3.0, " mor": 1.0, " im ": 2.0}, [" trash can ", " the morons "], (-3.0, 0.5, 0.8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    for i, text in enumerate(texts):
        folded = toxicity.fold_text(text or "")
        spared = {at + k for e in lexicon.exceptions for at in range(len(folded)) if folded.startswith(e, at) for k in range(len(e) - 1)} if len(folded) < 5000 else set()
        hits = [max(found) for at in range(len(folded)) if folded[at] == " " and at not in spared and (found := [w for p, w in lexicon.weights.items() if folded.startswith(p, at)])]
        density = 100 * sum(hits) / max(folded.count(" ") - 1, 1)
        x = -3.0 + 0.5 * round(max(hits, default=0.0), 1) + 0.8 * round(math.log1p(density), 1)
        assert abs(got[i].score - 1 / (1 + math.exp(-x))) < 1e-12, texts[i]


def _plain_statistics(text):
    data = text.encode()
    words = data.split()
    size = [len(w) for w in words]
    n, triples = len(words), [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    symbol = lambda b: b not in b" \t\r\x0b\x0c\n.,;:?'\"()-!|" and not chr(b).isalnum() and b < 128
    count = lambda f: sum(map(f, data))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    share = [c / len(data) for c in Counter(data).values()]
    per = lambda a, b: a / max(b, 1)
    return [
        math.log1p(n), per(sum(size), n), per(len(set(words)), n), per(sum(a == b for a, b in zip(words, words[1:])), n), per(len(set(triples)), n - 2),
        per(upper, upper + lower), per(count(symbol), len(data)), per(data.count(b"|"), n), per(data.count(b"!"), n), per(count(lambda b: 48 <= b <= 57), len(data)),
        per(count(lambda b: b in b".,;:?'\"()-"), n), per(data.count(b"\n"), n), per(count(lambda b: b >= 128), len(data)), per(sum(symbol(w[-1]) or w[-1:] == b"!" for w in words), n),
        math.log1p(data.count(b"\n")), -sum(p * math.log2(p) for p in share), math.log1p(max(size, default=0)),
    ]


def test_statistics_by_plain_counting(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").limit(60).collect()] + ["", " ", "a", "!! a|b c#", "é é é\n\nÀ b", "same same same same"]
    assert np.allclose(quality.statistics([t.encode() for t in texts]), [_plain_statistics(t) for t in texts], atol=1e-9)


def _rising(y, n):
    """The best rising fit, by its formula of minima and maxima."""
    s, k = np.concatenate(([0], np.cumsum(y))), np.concatenate(([0], np.cumsum(n)))
    mean = lambda a, b: (s[b] - s[a]) / (k[b] - k[a])
    return [max(min(mean(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))]


def test_quality_by_one_matrix(spark):
    docs, labels = _corpus(spark, 240)
    known = labels.select("doc_id", F.col("quality").alias("label"))
    got = {r.doc_id: r.score for r in quality.classify(docs, known).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    x = quality.statistics([texts[i].encode() for i in ids]).astype(np.float32).astype(float)
    y = {r.doc_id: r.label for r in known.collect()}
    train = [k for k, i in enumerate(ids) if i in y and zlib.crc32(str(i).encode()) % 5 != 0]
    model = quality.Model(x[train].mean(0), x[train].std(0))
    z, t = model.features(x[train]), np.array([y[ids[k]] for k in train], dtype=float)
    penalty = quality.RIDGE * len(train) * np.eye(z.shape[1])
    penalty[0, 0] = 0
    model.beta = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ t)
    raw = np.round(z @ model.beta, 3)
    steps = sorted(set(raw))
    fit = _rising([t[raw == v].sum() for v in steps], [float((raw == v).sum()) for v in steps])
    assert np.allclose(quality.isotonic(np.array(steps), np.array([t[raw == v].sum() for v in steps]), np.array([float((raw == v).sum()) for v in steps]))[1], sorted(set(np.round(fit, 12))), atol=1e-9)
    model.steps = quality.isotonic(np.array(steps), np.array([t[raw == v].sum() for v in steps]), np.array([float((raw == v).sum()) for v in steps]))
    assert np.allclose([got[i] for i in ids], model.score(x), atol=1e-4)


def test_language_by_plain_cosines(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    idf, langs, centroids, _ = language.fit(known)

    def grams(text):
        folded = b" " + b" ".join(bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()).split()) + b" "
        return Counter((int.from_bytes(folded[k : k + m], "big") * (2246822519 if m == 2 else 2654435761) & 0xFFFFFFFF) >> 20 for m in (2, 3) for k in range(len(folded) - m + 1))

    texts = [r.text for r in known.collect()]
    seen = Counter(g for t in texts for g in grams(t))
    frequency = Counter(g for t in texts for g in set(grams(t)))
    assert seen and np.allclose(idf, [math.log((1 + len(texts)) / (1 + frequency[g])) + 0.1 for g in range(language.DIMS)])
    got = {r.doc_id: r for r in language.identify(docs, reject=None).collect()}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        v = {g: (1 + math.log(n)) * idf[g] for g, n in grams(r.text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[g]) for g, x in v.items()) / size for c in centroids]
        best = max(cosine)
        assert abs(got[r.doc_id].score - best) < 1e-4 and got[r.doc_id].lang_pred in {lang for lang, c in zip(langs, cosine) if best - c < 1e-4}


def test_one_scan_samples_each_language(spark):
    rows = [(i, "some words here", "en" if i % 10 else "xx") for i in range(3000)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, langs, _, _ = language.fit(known, max_per_language=200)
    assert set(langs) == {"en", "xx"}


def test_samples_of_any_number_of_rows(spark):
    rows = spark.range(1_000_000).withColumnRenamed("id", "doc_id")
    for n, most in ((1_000_000, 500), (10**12, 500_000_000), (10**12, 10**12), (10**15, 5 * 10**11)):  # as if rows stood for n of them
        want = min(1.0, most / n) * 1_000_000
        assert abs(rows.where(learning.drawn(10, most, n)).count() - want) <= 6 * want**0.5
        assert rows.withColumn("n", F.lit(n)).where(learning.drawn(10, most, F.col("n"))).count() == rows.where(learning.drawn(10, most, n)).count()
    low = rows.agg(F.min(learning.fraction(10)), F.countDistinct(learning.fraction(10))).first()
    assert 0 < low[0] < 1e-4 and low[1] == 1_000_000


def test_no_language_vanishes_among_many_rows(spark, monkeypatch):
    """Every language counted as 10^12 times as many rows, and as many asked for: what a table of that size gives."""
    docs = spark.createDataFrame([(i, t, la) for i in range(400) for t, la in ((f"the cat and the dog {i % 7}", "en"),)] + [(400 + i, f"der hund und die katze {i % 7}", "de") for i in range(400)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "drawn", lambda seed, most, n: learning.drawn(seed, most * 10**12, n * 10**12))
    found = language.identify(docs, max_per_language=100, reject=None).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 400 else "de") for r in found)


# ---- the pipeline ----


def _mixed_by_hand(rows):
    """(doc_id, text, source) -> how often each is taken."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t, _) in enumerate(rows)}
    total = defaultdict(int)
    for k, (_, _, s) in enumerate(rows):
        total[s] += size[k]
    target, copies = _targets_by_hand(total), {}
    for s in total:
        mine = sorted((size[k], hashlib.md5(f"orrery:{i}".encode()).hexdigest(), i, k) for k, (i, _, x) in enumerate(rows) if x == s)
        rate = min(round(target[s], 4) / total[s], 3.0) if total[s] else 0.0
        u = int(hashlib.md5(f"orrery:{s or ''}".encode()).hexdigest()[:4], 16) % 1024 / 1024
        for rank, (_, _, i, _) in enumerate(mine, 1):
            copies[i] = min(math.floor(rank * rate + u) - math.floor((rank - 1) * rate + u), 3)
    return copies


def test_pipeline_by_hand(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = {r.doc_id for r in p.good_quality(spark, docs, D).collect()}  # the classifier's verdicts are taken as given
    assert 100 < len(good) < docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    before = {i: t for i, t, _ in rows}
    rows = [(i, t) for i, t in _lines_by_hand(rows, 10) if t == before[i] or (t or "").strip(" \t\n\r\x0b\x0c")]
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    rows = [(i, t) for i, t in rows if root(i) == i]
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = _words(r.text)
        m = min(10, len(w))
        windows[m] |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    leaks = lambda w: any(tuple(w[k : k + m]) in found for m, found in windows.items() for k in range(len(w) - m + 1))
    rows = [(i, t, source[i]) for i, t in rows if not leaks(_words(t))]
    copies = _mixed_by_hand(rows)
    text = {i: t for i, t, _ in rows}
    got = p.run(spark, D)
    assert got.columns == [*docs.columns, "copy"]
    found = sorted((r.doc_id, r.copy, r.text, r.n_chars) for r in got.collect())
    assert found == sorted((i, k, text[i], len(text[i])) for i, n in copies.items() for k in range(1, n + 1))


def test_stages_of_odd_rows(spark):
    import corpus_pipeline as p

    odd = [(1, None, "a"), (1, None, "a"), (None, "some words", None), (None, "some words", None), (2, "", "b"), (3, "x " * 50_000, "b"), (4, " \n ", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in odd], "doc_id long, text string, lang string, source string, n_chars long, copy int, `a.b` int")
    for name, stage in p.STAGES:
        for table in (docs, docs.limit(0)):
            found = stage(spark, table, D)
            n = found.count()
            assert set(docs.columns) <= set(found.columns), name
            assert n == 0 if table is not docs else (n == len(odd) or name in ("near_dedup", "mixing", "quality")), (name, n)
    assert p.one_of_each(spark, docs, D).count() == 6 and mixing.mix(docs).where("size = 0 AND taken > 0").count() == 0
