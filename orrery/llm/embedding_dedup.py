"""Near-duplicate embeddings: a navigable small-world graph a shard, every shard searched for every vector, links checked, linked vectors joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .common import discard, materialize, mix64
from .near_dedup import components

#: The cosine from which two vectors are near-duplicates.
COSINE = 0.9
#: Shards a length of vectors at least, so that graphs are built beside each other, and bytes of doubles a shard at most.
MIN_SHARDS, SHARD_BYTES = 4, 16 << 20
#: Vectors that go through a graph in one task.
BLOCK_ROWS = 16_384
#: The first width of the beams, how many vectors an audit looks at (a bounded sample), and the share of links and of probes that a search must find.
WIDTH, AUDIT_ROWS, RECALL = 64, 256, 0.995


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).reshape(n, -1) if n else np.zeros((0, 1))


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: not null or empty, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _key(v: Column) -> Column:
    """Two 64-bit hashes of a vector."""
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))


def distinct_vectors(rows: DataFrame, min_shards: int = MIN_SHARDS, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, v, key) -> a table with a row a distinct vector: node (a number), first_id, n_rows, dim, v, and its shard and block among shards and blocks of its length."""
    nodes = rows.groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    nodes = materialize(nodes.select("key", F.monotonically_increasing_id().alias("node"), "first_id", "n_rows", F.size("v").alias("dim"), "v"))
    of = lambda most: F.ceil(F.count(F.lit(1)) / most).cast("int")
    sizes = materialize(nodes.groupBy("dim").agg(F.greatest(F.lit(min_shards), F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / shard_bytes).cast("int")).alias("shards"), of(block_rows).alias("blocks")))
    dealt = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(of).cast("long")).cast("int")
    found = materialize(nodes.join(sizes, "dim").select(*nodes.columns, "shards", "blocks", dealt(1, "shards").alias("shard"), dealt(2, "blocks").alias("block")))
    discard(nodes)
    discard(sizes)
    return found


GRAPH = "dim int, blocks int, shard int, place int, entry boolean, node long, n_rows long, v array<{}>, links array<int>, upper array<int>"


def graphs(nodes: DataFrame) -> DataFrame:
    """distinct_vectors() -> a table of the shards' graphs, a row a node: its place, whether searches begin there, its links at the lowest level and those above, all of one number a level."""
    kind = nodes.schema["v"].dataType.elementType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        number = group.column("node").to_numpy()
        top = hnsw.levels(number)
        order = np.lexsort((number, -top))
        group = group.take(pa.array(order))
        graph = hnsw.build(hnsw.unit(_matrix(group.column("v"), len(order))), top[order])
        entry = np.zeros(len(order), dtype=bool)
        entry[graph.entries] = True
        upper = [np.concatenate([x[k] for x in graph.links[1:] if k < len(x)] or [np.zeros(0, dtype=np.int32)]) for k in range(len(order))]
        made = {"place": pa.array(np.arange(len(order)), pa.int32()), "entry": pa.array(entry), "links": pa.array(list(graph.links[0]), pa.list_(pa.int32())), "upper": pa.array(upper, pa.list_(pa.int32()))}
        return pa.table([made[c] if c in made else group.column(c) for c in names], names=names)

    names = [x.split()[0] for x in GRAPH.split(", ")]
    columns = nodes.select("dim", "blocks", "shard", "node", "n_rows", "v")
    return materialize(columns.groupBy("dim", "shard").applyInArrow(build, GRAPH.format(kind)))


def _graph(rows: pa.Table) -> tuple[hnsw.Graph, np.ndarray, np.ndarray]:
    """A graph from its rows, its nodes' numbers and how many rows each stands for."""
    rows = rows.sort_by("place").combine_chunks()
    n = rows.num_rows
    upper = rows.column("upper").combine_chunks()
    depth = np.diff(upper.offsets.to_numpy()) // hnsw.LINKS
    flat, first = upper.flatten().to_numpy(), upper.offsets.to_numpy()[:-1] - upper.offsets.to_numpy()[0]
    links = [_matrix(rows.column("links"), n)]
    for level in range(1, int(depth.max(initial=0)) + 1):
        at = first[depth >= level] + (level - 1) * hnsw.LINKS
        links.append(flat[at[:, None] + np.arange(hnsw.LINKS)])
    graph = hnsw.Graph(hnsw.unit(_matrix(rows.column("v"), n)), links, np.flatnonzero(rows.column("entry").to_numpy()))
    return graph, rows.column("node").to_numpy(), rows.column("n_rows").to_numpy()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (a, b) join: each node's and the smallest one that it leads to."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            on = label != np.arange(len(node))
            return node[on], node[label[on]]
        label = new


def search(made: DataFrame, queries: DataFrame, cosine: float = COSINE, width: int = WIDTH) -> DataFrame:
    """graphs() and (dim, shards, block, node, v) -> node, n_found, n_links, joined: what each query finds in each shard.

    n_found nodes other than itself, that stand for n_links rows; joined leads to the smallest node that the links of the task's queries lead to, so that links are joined without being
    rows. Rows with n_found = 0 only join a node of the shard. A query goes to all shards of its length, a block of them a task.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = made.withColumn("block", every("blocks"))
    right = queries.select("dim", every("shards").alias("shard"), "block", "node", "v")

    def find(graph_rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, dtype=np.int64)] for c in ("node", "n_found", "n_links", "joined")}
        if graph_rows.num_rows and asked.num_rows:
            graph, number, n_rows = _graph(graph_rows)
            mine, q = asked.column("node").to_numpy(), hnsw.unit(_matrix(asked.column("v"), asked.num_rows))
            a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            step = max(1, hnsw.MARKS // len(number))
            for low in range(0, len(q), step):
                r, c = graph.within(q[low : low + step], cosine, width)
                other = mine[low + r] != number[c]
                r, c = r[other], c[other]
                found = np.bincount(r, minlength=len(q[low : low + step]))
                some = np.flatnonzero(found)
                out["node"].append(mine[low + some])
                out["n_found"].append(found[some])
                out["n_links"].append(np.bincount(r, weights=n_rows[c], minlength=len(found))[some].astype(np.int64))
                out["joined"].append(mine[low + some])
                a, b = _forest(np.concatenate((a, mine[low + r])), np.concatenate((b, number[c])))
            out["node"].append(a)
            out["joined"].append(b)
            for c in ("n_found", "n_links"):
                out[c].append(np.zeros(len(a), dtype=np.int64))
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    by = ("dim", "shard", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(find, "node long, n_found long, n_links long, joined long")


# ---- audit ----


def _sampled(nodes: DataFrame, cosine: float, rows: int) -> pa.Table:
    """Queries of an audit: some nodes, those with the smallest hashes, and for each a probe in a drawn direction, just within the wanted cosine of it (numbered below zero)."""
    some = nodes.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(rows).select("dim", "shards", "node", "v").toArrow()
    probes = []
    for v, node in zip(some.column("v").to_pylist(), some.column("node").to_pylist(), strict=True):
        a = hnsw.unit(np.array([v]))[0]
        r = np.random.default_rng(int(mix64(np.array([node], dtype=np.uint64))[0])).normal(size=len(a))
        r -= (r @ a) * a
        c = min(1.0, cosine + 1e-4)
        probes.append(c * a + np.sqrt(1 - c * c) * r / max(np.linalg.norm(r), 1e-300) if len(a) > 1 else a)
    kind = some.schema.field("v").type
    probe = pa.table({"dim": some.column("dim"), "shards": some.column("shards"), "node": pa.array(-1 - np.arange(len(probes)), pa.int64()), "v": pa.array(probes, kind) if probes else pa.array([], kind)})
    both = pa.concat_tables([some.cast(probe.schema), probe])
    return both.append_column("block", pa.array(np.zeros(both.num_rows), pa.int32()))


def _true_links(nodes: DataFrame, asked: pa.Table, cosine: float) -> dict[int, int]:
    """How many nodes each query of an audit should find: all rows are compared with it, and a partition sends a number a query."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(asked.column("dim").to_pylist()):
        mine = asked.filter(pc.equal(asked.column("dim"), dim))
        by_dim[dim] = mine.column("node").to_numpy(), hnsw.unit(_matrix(mine.column("v"), mine.num_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros(len(number), dtype=np.int64) for dim, (number, _) in by_dim.items()}
        for batch in batches:
            for dim, (number, q) in by_dim.items():
                part = pa.Table.from_batches([batch.filter(pc.equal(batch.column("dim"), dim))])
                for low in range(0, part.num_rows, 4096):
                    rows = part.slice(low, 4096)
                    near = q @ hnsw.unit(_matrix(rows.column("v"), rows.num_rows)).T >= cosine
                    total[dim] += (near & (number[:, None] != rows.column("node").to_numpy()[None, :])).sum(axis=1)
        numbers = [number for number, _ in by_dim.values()] or [np.zeros(0, dtype=np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate([*total.values()] or numbers))], names=["node", "n"])

    return {r.node: r.n for r in nodes.select("dim", "node", "v").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}


def audited_width(nodes: DataFrame, made: DataFrame, cosine: float = COSINE, width: int = WIDTH, rows: int = AUDIT_ROWS, recall: float = RECALL) -> tuple[int, list[tuple[int, float, float]]]:
    """The width, doubled until the searches of an audit find the wanted share of links and of probes, and what each width found: (width, share of links, share of probes).

    Where hardly any vectors are linked, the probes still are: each has a vector at the edge of the wanted cosine. A beam as wide as a shard misses nothing.
    """
    asked = _sampled(nodes, cosine, rows)
    tried: list[tuple[int, float, float]] = []
    if not asked.num_rows:
        return width, tried
    true = _true_links(nodes, asked, cosine)
    largest = made.groupBy("dim", "shard").count().agg(F.max("count")).first()[0]
    queries = nodes.sparkSession.createDataFrame(asked)
    while True:
        found = {r.node: r.n for r in search(made.withColumn("blocks", F.lit(1)), queries, cosine, width).groupBy("node").agg(F.sum("n_found").alias("n")).where("n > 0").collect() if r.node in true}
        shares = []
        for below in (False, True):
            want = {k: n for k, n in true.items() if (k < 0) == below}
            shares.append(sum(min(found.get(k, 0), n) for k, n in want.items()) / max(1, sum(want.values())) if any(want.values()) else 1.0)
        tried.append((width, *shares))
        if min(shares) >= recall or width >= largest:
            return width, tried
        width *= 2


# ---- whole tables ----


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, width: int = WIDTH, recall: float = RECALL, **sizes: int) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links (other rows within the cosine), component_id (the smallest id that links lead to), kept (whether that is its own), a row a row.

    Equal vectors are one node with a count, so that a group of copies is searched for once. Each node looks for others in every shard of its length; what the graphs lead to is
    checked in double precision, so no link is below the cosine. An audit widens the beams first. The number of searches is that of vectors times shards, and a group of
    g different vectors within the cosine of each other costs g^2 checks, as their links are counted, but none of its links is a row.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do rows without an id and vectors of different lengths. Repeated rows link with each other; rows
    with equal id and different vectors count each. No rows give no rows; other columns don't matter. sizes: min_shards, shard_bytes, block_rows of distinct_vectors().
    """
    v = F.col("embedding")
    usable = _usable(v) & F.col("vec_id").isNotNull()
    plus = F.transform(v, lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType))  # no minus zero
    rows = vectors.select("vec_id", F.when(usable, plus).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), _key(F.col("v"))))
    keyed = materialize(rows.select("vec_id", "key"))
    nodes = distinct_vectors(rows.where("key IS NOT NULL"), **sizes)
    made = graphs(nodes)
    width, _ = audited_width(nodes, made, cosine, width, recall=recall)
    found = materialize(search(made, nodes, cosine, width))
    discard(made)
    links = materialize(found.where("node != joined").select(F.col("node").alias("a"), F.col("joined").alias("b")))
    labels = components(links)
    counted = materialize(found.groupBy("node").agg(F.sum("n_links").alias("n_links")))
    for table in (found, links):
        discard(table)
    placed = nodes.select("key", "node", "first_id", "n_rows").join(counted, "node", "left").join(labels, "node", "left")
    placed = materialize(placed.select("key", "first_id", (F.coalesce("n_links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")))
    firsts = materialize(placed.groupBy("label").agg(F.min("first_id").alias("component_id")))
    settled = materialize(placed.join(firsts, "label").select("key", "n_links", "component_id"))
    for table in (nodes, labels, counted, placed, firsts):
        discard(table)
    # rows without a key are many perhaps; they meet nothing
    met = keyed.where("key IS NOT NULL").join(settled, "key").select("vec_id", "n_links", "component_id")
    lone = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_first(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows of vectors, unchanged, whose id is the smallest of its component; rows that link with nothing stay. Repeated ids stay or go together."""
    gone = near_duplicates(vectors, cosine).where("NOT kept").select(F.col("vec_id").alias("gone")).distinct()
    return vectors.join(gone, vectors["vec_id"] == F.col("gone"), "left_anti")


#: DuckDB SQL for near_duplicates() by all pairs, for unique ids: small tables only.
PAIRS_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM {embeddings} WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT p.a, reach.b FROM reach JOIN p ON p.b = reach.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM {embeddings} e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
