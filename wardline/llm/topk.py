"""Exact top-k search by inner product with a dual cover tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import arrow_batches, write_table

SCALE = 256
LEAVES = 64  # nodes at the bottom of the tree
SAMPLE = 2048  # vectors, chosen by digest, that the tree's centres are taken from; every vector is indexed
CHUNK, BLOCK = 4096, 1024  # data vectors and queries of one comparison
SALTS = 64


@dataclass
class Node:
    centre: np.ndarray
    leaf: int | None = None
    children: list[Node] = field(default_factory=list)
    radius: float = -1.0  # of the data below; negative: none
    query_radius: float = -1.0
    worst: float = np.inf  # the lowest kth score of the queries below


def quantised(vector: Column) -> Column:
    """floor(SCALE x component) as bigint; null for a vector that is null or holds a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = vector.isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * SCALE).cast("long")))


def _packed(column: str) -> Column:
    """The components as one string of hex numbers of 16 digits: a compact grouping key."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _unpacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=">i8").astype(np.int64).reshape(len(raw), -1)


def cover_tree(points: np.ndarray, leaves: int) -> Node:
    """A cover tree over centres taken from `points`: each level halves the covering radius of the one above.

    Centres are added farthest first, so a prefix of them covers all points within the distance of the next.
    A level ends where that distance has halved; a centre's parent is the nearest centre of the level above,
    and each centre goes on as its own child.
    """
    order, distance = [0], np.linalg.norm(points - points[0], axis=1)
    reach = [float(distance.max())]
    while len(order) < leaves and distance.max() > 0:
        order.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(points - points[order[-1]], axis=1))
        reach.append(float(distance.max()))
    centres = points[order]
    sizes, radius = [1], reach[0]
    for n, r in enumerate(reach, 1):
        if r <= radius / 2 and n > sizes[-1]:
            sizes.append(n)
            radius = r
    if sizes[-1] < len(order):
        sizes.append(len(order))
    level = [Node(centres[0])]
    root = level[0]
    for size in sizes[1:]:
        below = [Node(c) for c in centres[:size]]
        for i, node in enumerate(below):
            parent = i if i < len(level) else int(np.linalg.norm(centres[:len(level)] - node.centre, axis=1).argmin())
            level[parent].children.append(node)
        level = below
    for i, node in enumerate(level):
        node.leaf = i
    return root


def _leaf_centres(node: Node) -> dict[int, np.ndarray]:
    return {node.leaf: node.centre} if node.leaf is not None else {k: v for c in node.children for k, v in _leaf_centres(c).items()}


def _measure(node: Node, data: dict[int, float], queries: dict[int, tuple[float, float]]) -> None:
    """Covering radii and worst scores from the leaves up."""
    if node.leaf is not None:
        node.radius = data.get(node.leaf, -1.0)
        node.query_radius, node.worst = queries.get(node.leaf, (-1.0, np.inf))
        return
    for child in node.children:
        _measure(child, data, queries)
        gap = float(np.linalg.norm(node.centre - child.centre))
        node.radius = max(node.radius, gap + child.radius if child.radius >= 0 else -1.0)
        node.query_radius = max(node.query_radius, gap + child.query_radius if child.query_radius >= 0 else -1.0)
        node.worst = min(node.worst, child.worst)


def surviving_pairs(root: Node) -> list[tuple[int, int]]:
    """Leaf pairs (query, data) that may hold a better score: a node pair is pruned when no inner product between its balls reaches the group's worst kth score."""
    found, open_ = [], [(root, root)]
    while open_:
        q, d = open_.pop()
        if q.query_radius < 0 or d.radius < 0:
            continue
        cq, cd = np.linalg.norm(q.centre), np.linalg.norm(d.centre)
        bound = float(q.centre @ d.centre) + q.query_radius * cd + d.radius * cq + q.query_radius * d.radius
        if bound * (1 + 1e-9) + 1e-6 < q.worst:
            continue
        if q.leaf is not None and d.leaf is not None:
            found.append((q.leaf, d.leaf))
        elif d.leaf is not None or (q.leaf is None and q.query_radius > d.radius):
            open_ += [(c, d) for c in q.children]
        else:
            open_ += [(q, c) for c in d.children]
    return found


def _assigned(rows: DataFrame, centres: np.ndarray, schema: str) -> DataFrame:
    """Add the nearest leaf and the distance to its centre."""
    squares = (centres ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _unpacked(batch.column(0).to_pylist()).astype(np.float64)
            leaf = (squares - 2 * points @ centres.T).argmin(axis=1)
            gap = np.linalg.norm(points - centres[leaf], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "leaf", "gap"])

    return rows.mapInArrow(run, f"{schema}, leaf int, gap double")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point only where every sum is below 2^53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Per query of a block the `k` best vectors of a chunk, ties to smaller ids, without the query's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                queries, data = _unpacked([x["v"] for x in row["block"]]), _unpacked([x["v"] for x in row["chunk"]])
                ids = [sorted(x["ids"]) for x in row["chunk"]]
                scores = _products(queries, data)
                keep = min(k + 1, data.shape[0])
                least = np.partition(scores, data.shape[0] - keep, axis=1)[:, data.shape[0] - keep]
                for i, query in enumerate(row["block"]):
                    near = np.flatnonzero(scores[i] >= least[i])
                    ranked = sorted((-int(scores[i, j]), x) for j in near for x in ids[j] if x != query["id"])[:k]
                    out[0].extend([query["id"]] * len(ranked))
                    out[1].extend(x for _, x in ranked)
                    out[2].extend(-s for s, _ in ranked)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _top(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` under `is_query` its k highest inner products among all other rows.

    Components are `quantised`; ties go to the smaller id; a query with fewer candidates gets them all. Null
    vectors, vectors with null or non-finite components and rows without an id take no part. Rows that repeat
    an id count as one if their vector is the same, else as candidates each. An empty table gives an empty result.
    Vectors must have one length.

    Method: equal vectors become one entry with its k + 1 smallest ids, found in salted parts first. A cover tree over
    centres from a bounded sample holds queries and data: every vector goes to its nearest leaf, leaf radii are
    grouped maxima. Each query is first compared with its own leaf; its kth score there bounds the dual
    traversal, which runs over nodes only, on the driver. The surviving leaf pairs are compared exactly, in
    blocks of queries against chunks of data.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), quantised(F.col(vector_col)).alias("x")).filter("x is not null and id is not null")
    rows = write_table(sound.select("id", F.coalesce("q", F.lit(False)).alias("q"), _packed("x").alias("v")), "vectors")
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    salted = Window.partitionBy("v", "salt").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    first = rows.select("v", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    entries = first.select("v", "id").distinct().withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").to_pylist()
    root = cover_tree(_unpacked(sample).astype(np.float64), LEAVES)
    found = _leaf_centres(root)
    centres = np.stack([found[i] for i in range(len(found))])
    with arrow_batches(spark, 2000):
        data = write_table(_assigned(entries.select("v", "ids"), centres, "v binary, ids array<bigint>"), "entries")
        queries = write_table(_assigned(rows.filter("q").select("v", "id").distinct(), centres, "v binary, id bigint"), "queries")
    sizes = data.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # one row per leaf
    asked = queries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()
    chunks = spark.createDataFrame([(r["leaf"], -(-r["n"] // CHUNK)) for r in sizes], "at int, chunks int")
    parts = data.join(F.broadcast(chunks), F.col("leaf") == F.col("at")).groupBy("leaf", F.pmod(F.xxhash64("v"), "chunks").alias("part")).agg(F.collect_list(F.struct("v", "ids")).alias("chunk"))
    parts = write_table(parts.select("leaf", "chunk"), "chunks")
    blocks = max(1, -(-sum(r["n"] for r in asked) // BLOCK))

    def compared(pairs: list[tuple[int, int]]) -> DataFrame:
        wanted = spark.createDataFrame(pairs, "own int, other int")
        spread = queries.join(F.broadcast(wanted), F.col("leaf") == F.col("own")).select("other", "id", "v")
        grouped = spread.groupBy("other", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("block"))
        both = parts.join(grouped.select("other", "block"), F.col("leaf") == F.col("other")).select("block", "chunk")
        with arrow_batches(spark, 4):
            return write_table(_best(both, k), "best")

    own = compared([(r["leaf"], r["leaf"]) for r in asked])
    kth = _top(own, k).filter(F.col("rank") == k).select("query_id", "score")
    worst = queries.join(kth, F.col("id") == F.col("query_id"), "left").groupBy("leaf").agg(F.min("score").alias("worst"), F.sum(F.col("score").isNull().cast("int")).alias("short")).collect()
    level = {r["leaf"]: -np.inf if r["short"] else float(r["worst"]) for r in worst}
    _measure(root, {r["leaf"]: r["radius"] for r in sizes}, {r["leaf"]: (r["radius"], level[r["leaf"]]) for r in asked})
    rest = [(q, d) for q, d in surviving_pairs(root) if q != d]
    every = own.unionByName(compared(rest)) if rest else own
    return _top(every.distinct(), k).select("query_id", "rank", "vec_id", "score")
