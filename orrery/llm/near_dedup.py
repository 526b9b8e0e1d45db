"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check, connected classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, discard, materialize, mix64, text_chunks

#: Words a shingle, and the similarity from which two documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows a band: of pairs at similarity 0.8, all but (1 - 0.8^5)^20 = 0.03 % share a band.
BANDS, ROWS = 20, 5
#: Bytes of shingle hashes a block, where members of a bucket are compared block against block.
BLOCK_BYTES = 8 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(texts: list[bytes], weighting: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and weight of each distinct shingle, in the order of documents.

    A text of fewer words than a shingle, but not none, is one shingle. weighting: "set" (each weighs 1) or "count".
    """
    words = Words(texts)
    n_words = np.diff(words.first)
    grams = words.grams(SHINGLE)
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)
    inside = doc_of_word[SHINGLE - 1 :] == doc_of_word[: len(doc_of_word) - SHINGLE + 1] if len(doc_of_word) >= SHINGLE else np.zeros(0, dtype=bool)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    doc = np.concatenate((doc_of_word[: len(grams)][inside], short))
    x = np.concatenate((grams[inside], words.span(words.first[short], words.first[short + 1])))
    key = mix64(x ^ (doc.astype(np.uint64) * _C[0]))
    order = np.argsort(key)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[order][1:] != key[order][:-1]
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(key))).astype(float) if weighting == "count" else np.ones(len(at))
    doc, x = doc[order][at], x[order][at]
    order = np.argsort(doc, kind="stable")
    return doc[order], x[order], weight[order]


def dart_minhash(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of weighted sets given as rows (doc, x, weight).

    Each unit of an element's weight is a strip into which darts fall as a Poisson process in time, the same for every document,
    drawn from hashes of the element; the last strip is as wide as the rest of the weight and only darts within that width count. A dart
    belongs to one of k coordinates, and a coordinate keeps the earliest one. Darts up to the time (k ln k + 2 k) / total weight are
    thrown: about that many in all, however many elements there are. A document with a coordinate left empty is thrown again up to twice the time.
    Two documents agree on a coordinate with the probability of their weighted Jaccard similarity. Documents without elements have zeros.
    """
    found = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    until = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    strips = np.ceil(weight).astype(np.int64)
    strip_doc, strip_x = np.repeat(doc, strips), np.repeat(x, strips)
    number = np.arange(len(strip_doc)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.minimum(1.0, np.repeat(weight, strips) - number)
    strip_x = mix64(strip_x + number.astype(np.uint64) * _C[1])
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(n, dtype=bool)
        mine[todo] = True
        live = np.flatnonzero(mine[strip_doc])
        time = np.zeros(len(live))
        keys, times, ids = [], [], []
        throw = 0
        while len(live):
            h = mix64(strip_x[live] + np.uint64((throw + 1) * int(_C[2]) % 2**64))
            time = time - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
            on = time <= until[strip_doc[live]]
            live, time, h = live[on], time[on], h[on]
            within = ((mix64(h ^ _C[3]) >> np.uint64(11)).astype(float) / 2.0**53) < width[live]
            dart = mix64(h ^ _C[0])
            keys.append((strip_doc[live] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64))[within])
            times.append(time[within])
            ids.append(dart[within])
            throw += 1
        key, time, dart = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((time, key))
        key = key[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        filled = np.bincount(key[first] // k, minlength=n)
        found.reshape(-1)[key[first]] = dart[order][first]
        todo = todo[filled[todo] < k]
        found[todo] = 0
        until[todo] *= 2
    return found


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, bands array<long> (a hash of each band's coordinates; empty without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                n = len(texts)
                doc, x, weight = shingles(texts, weighting)
                size = np.bincount(doc, minlength=n)
                sig = dart_minhash(doc, x, weight, n, bands * rows).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _C[1], (n, bands)).copy()
                for r in range(rows):
                    key = mix64(key * _C[2] + sig[:, :, r])
                listed = pa.array([k if s else [] for k, s in zip(key.view(np.int64), size, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(size, pa.int64()), listed], names=["doc_id", "text_key", "n_shingles", "bands"])

    keyed = docs.select("doc_id", F.md5("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key string, n_shingles long, bands array<long>")


def similarities(pairs: DataFrame, weighting: str = "set") -> DataFrame:
    """(a, b, text_a, text_b) -> a, b, similarity: exact weighted Jaccard similarity of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, texts_a in text_chunks(batch, "text_a"):
                at = 0
                for part, texts_b in text_chunks(half, "text_b"):
                    n = len(texts_b)
                    sides = []
                    for texts in (texts_a[at : at + n], texts_b):
                        doc, x, w = shingles(texts, weighting)
                        sides.append((mix64(x ^ (doc.astype(np.uint64) * _C[0])), doc, w))
                    at += n
                    (ka, da, wa), (kb, db, wb) = sides
                    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                    both = np.bincount(da[ia], weights=np.minimum(wa[ia], wb[ib]), minlength=n)
                    total = np.bincount(da, weights=wa, minlength=n) + np.bincount(db, weights=wb, minlength=n) - both
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(total, 1))], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> node, label (the smallest id that links lead to). Labels spread to neighbours and jump to their label's label until none changes."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        new = materialize(spread.join(target, spread.label == target.t).select("node", "old", F.least("label", "jump").alias("label")))
        changed = new.where("label != old").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        if not changed:
            discard(both)
            return labels


def shingle_sets(texts: DataFrame, weighting: str = "set") -> DataFrame:
    """(node, text) -> node, shingles array<long> (hashes), weights array<float>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in text_chunks(batch):
                doc, x, weight = shingles(found, weighting)
                edge = pa.array(np.searchsorted(doc, np.arange(len(found) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(v)) for v in (x.view(np.int64), weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("node"), *lists], names=["node", "shingles", "weights"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>, weights array<float>")


def _links_across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, class, main) -> links (a, b) that join different classes of a bucket.

    Members outside the main class meet all members, block against block; a block pair gives the links that its classes need to join, not all pairs.
    A bucket has as many blocks as its shingles fill, so that few copies of them are made.
    """
    sized = members.join(sets.select("node", F.size("shingles").alias("size")), "node").groupBy("key").agg(F.ceil(F.sum("size") * 12 / BLOCK_BYTES).cast("int").alias("blocks"))
    members = members.join(materialize(sized), "key")
    own = F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)).cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))
    left = members.where("class != main").select("key", "node", "class", own.alias("left"), every.alias("right")).join(sets, "node")
    right = members.select("key", "node", "class", own.alias("right"), every.alias("left")).join(sets, "node")

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            sides = []
            for t in (a, b):
                t = t.combine_chunks()
                x, w = (np.asarray(pc.list_flatten(t.column(c))) for c in ("shingles", "weights"))
                x, w = x.view(np.uint64), w.astype(float)
                doc = np.asarray(pc.list_parent_indices(t.column("shingles"))).astype(np.int64)
                sides.append((doc, x, w, np.bincount(doc, weights=w, minlength=t.num_rows), t.column("node").to_numpy(), t.column("class").to_pylist()))
            (da, xa, wa, ta, na, ca), (db, xb, wb, tb, nb, cb) = sides
            order = np.argsort(xb, kind="stable")
            xs, ds, ws = xb[order], db[order], wb[order]
            low, high = np.searchsorted(xs, xa, "left"), np.searchsorted(xs, xa, "right")
            start = np.searchsorted(da, np.arange(len(na) + 1))
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.setdefault(c, c) != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for r in range(len(na)):
                own_ = slice(start[r], start[r + 1])
                size = high[own_] - low[own_]
                at = np.repeat(low[own_] - np.cumsum(size) + size, size) + np.arange(size.sum())
                both = np.bincount(ds[at], weights=np.minimum(ws[at], np.repeat(wa[own_], size)), minlength=len(nb))
                for k in np.flatnonzero(both >= (similarity - 1e-12) * (ta[r] + tb - both)):
                    p, q = root(ca[r]), root(cb[k])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((int(na[r]), int(nb[k])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    by = ("key", "left", "right")
    columns = [F.col(c).alias(c) for c in (*by, "node", "class", "shingles", "weights")]  # fresh ones: both sides come from the same tables
    return left.select(columns).groupBy(*by).cogroup(right.select(columns).groupBy(*by)).applyInArrow(join, "a long, b long").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> two tables: doc_id, text_key (a hash of the text), n_shingles of each document; and text_key, label, class_id of each text that has shingles and an id."""
    signed = materialize(signatures(docs, weighting=weighting))
    with_text = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "bands")).alias("f")
    # a number a text; once it is in a table it stays
    nodes = materialize(with_text.groupBy("text_key").agg(first).select("text_key", F.monotonically_increasing_id().alias("node"), F.col("f.doc_id").alias("first_id"), F.col("f.bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # aggregates become tables before large sides join them: then these joins are ones that Spark may split
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n"))
    met = materialize(keyed.join(shared, "key").select("key", "node", "n").distinct())
    discard(shared)
    # the member that meets most others over all its buckets is the likeliest to be near to all
    meeting = met.groupBy("node").agg(F.sum("n").alias("meets"))
    members = met.join(meeting, "node").select("key", "node", F.struct(F.col("meets"), (-F.col("node")).alias("minus")).alias("rank"))
    centers = materialize(members.groupBy("key").agg((-F.max("rank")["minus"]).alias("center")))
    members = materialize(members.drop("rank").join(centers, "key"))
    discard(met)
    discard(centers)
    wanted = nodes.select("node", "first_id", F.col("text_key").alias("wanted_key")).join(members.select("node").distinct(), "node", "left_semi")
    some = docs.select("doc_id", "text", F.md5("text").alias("key_of_text")).join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("key_of_text") == F.col("wanted_key")))
    texts = materialize(some.select("node", "text").dropDuplicates(["node"]))
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))

    pairs = members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(similarities(pairs.join(side("a"), "a").join(side("b"), "b"), weighting).where(F.col("similarity") >= similarity).select("a", "b"))
    labels = components(links)
    placed = materialize(members.join(labels, "node", "left").select("key", "node", "center", F.coalesce("label", "node").alias("class")))
    discard(members)
    open_ = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.when(F.col("node") == F.col("center"), F.col("class"))).alias("main")).where("low < high")
    rest = materialize(placed.join(materialize(open_.select("key", "main")), "key").select("key", "node", "class", "main"))
    discard(placed)
    if not rest.isEmpty():
        sets = materialize(shingle_sets(texts.join(rest.select("node").distinct(), "node", "left_semi"), weighting))
        links = links.unionByName(materialize(_links_across(rest, sets, similarity)))
        discard(labels)
        labels = components(links)
    discard(rest)
    discard(texts)
    labelled = nodes.select("text_key", "first_id", "node").join(labels, "node", "left").select("text_key", "first_id", F.coalesce("label", "node").alias("label"))
    ids = materialize(labelled.groupBy("label").agg(F.min("first_id").alias("class_id")))
    found = materialize(labelled.join(ids, "label").select("text_key", "label", "class_id"))
    for table in (nodes, labels, ids):
        discard(table)
    return signed.select("doc_id", "text_key", "n_shingles"), found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """(doc_id, text) -> doc_id, class_id, n_shingles, a row a document: documents that chains of near-duplicate links join share a class,
    whose id is its smallest doc_id.

    Texts that are equal fall together first, by their hash, so that a group of copies is one node. Nodes that share a band meet in its
    bucket. There, the smallest is compared with all others (links are checked exactly, by their shingles); members that this
    leaves outside its class are compared with all members of other classes in turn, until no pair of a bucket is neither in one class
    nor compared. So no link within a bucket is lost, and a bucket of copies costs as many comparisons as it has members.

    Null, empty and blank texts have no shingles and are classes of their own; so is a null id (class_id null). Repeated rows
    share a class. Rows with equal id and different texts are different documents, with classes of their own. Texts may be of any length. No rows give no rows.
    Other columns don't matter.
    """
    signed, found = classes(docs, similarity, weighting)
    shingled = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return signed.join(found, "text_key", "left").select("doc_id", F.when(shingled, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_shingles")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs, one of each class: the one with the smallest id (of equal ids, the one whose text has the smallest hash).

    Rows without an id all stay, repeated ones too. Those without words stay but for repeated ones: of rows with equal id and text one stays, the first by its other columns.
    Rows with equal id and different texts are told apart. No rows give no rows; columns of any name may stand beside doc_id and text.
    """
    signed, found = classes(docs, similarity)
    firsts = signed.where("doc_id IS NOT NULL AND n_shingles > 0").join(found, "text_key").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    firsts = materialize(firsts.select(F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("first_key")).unionByName(
        signed.where("doc_id IS NOT NULL AND n_shingles = 0").select(F.col("doc_id").alias("first_id"), F.coalesce("text_key", F.lit("")).alias("first_key")).distinct()))
    discard(found)
    discard(signed)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("key_of_text"), F.to_json(others).alias("rest"))
    mine = whole.join(firsts, (F.col("id") == F.col("first_id")) & (F.col("key_of_text") == F.col("first_key")), "left_semi")
    one = mine.withColumn("place", F.row_number().over(Window.partitionBy("id", "key_of_text").orderBy("rest"))).where("place = 1")
    return one.unionByName(whole.where("id IS NULL").withColumn("place", F.lit(1))).select("doc.*")
