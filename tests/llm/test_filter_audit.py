import random
import re
from collections import defaultdict
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import filter_audit

some_ids = st.lists(st.integers(0, 300), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(some_ids, st.lists(some_ids, max_size=5))
def test_merges_are_those_of_sets(ids, others):
    held = set().union(*others)
    assert filter_audit.union([ids, *others]) == sorted(held | set(ids))
    assert filter_audit.difference(ids, others) == sorted(set(ids) - held)
    assert filter_audit.common(ids, sorted(held)) == len(held & set(ids))
    for x in (0, 7, 150, 301):
        assert filter_audit.gallop(ids, x, 0) == sum(i < x for i in ids)


def by_hand(docs, labels):
    """Every order applied to every row, filter after filter."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    rows = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows[source or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, mine in rows.items():
        whole = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                whole[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), failing - len(removed), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), f]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = whole[v[-1]]
    return out


def test_every_order_equals_that_by_hand(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    say = lambda: " ".join(rng.choice(words[: rng.choice([20, 120])]) for _ in range(rng.choice([3, 60, 90]))) + rng.choice(["", "", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2])
    texts = [say() for _ in range(120)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for i in range(400)]
    docs += [(500, None, "a"), (501, "", "a"), (502, " \n", "c"), (None, texts[0], "a"), (None, texts[0], "a"), (3, texts[5], "b"), (3, texts[5], "b"), (-4, texts[1], "d"), (600, "word " * 300_000, "d"), (601, " ".join(map(str, range(200_000))), "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, A int, `part.x` string").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(frame, marks).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 5 * 600 and got == by_hand(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(frame, marks.limit(0)).collect()} == {0}


def test_a_hot_part_has_many_short_lists(spark):
    judged = filter_audit.document_filters(spark.range(3000).selectExpr("id AS doc_id", "'same' AS text", "'hot' AS source"))
    rows = filter_audit.with_labels(judged, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    lists = filter_audit.postings(rows, range_bits=6).collect()
    assert len(lists) >= 3000 / 64 and max(r.n for r in lists) <= 64 and sum(len(r.E) for r in lists) == 2999
    assert all(r.A == sorted(r.A) for r in lists)
