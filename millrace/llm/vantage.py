"""Approximate nearest neighbours with vantage-point trees, op8.

Vectors are dealt by hash to shards of about ``shard`` rows, each with a vantage-point tree: a node
splits its rows at the median distance from a vantage point. Trees and blocks of queries are flat files in the
shared folder; only their paths travel. Every block visits every shard (a stated query set against all rows), a
worker maps a tree once for all blocks that come to it, and the ``k`` best of each are merged.

Pruning: with d the query's distance from the vantage point, and the inner rows at most ``inner`` and the outer ones at
least ``outer`` from it, and t the query's k-th best so far, the inner side is skipped when ``factor`` (d - inner) > t and
the outer one when ``factor`` (outer - d) > t. ``factor`` 1 is the triangle inequality and thus exact; more is faster and may miss some.

Distances are Euclidean, in double precision, from differences of the original components; ties
go to the smaller vec_id. Null, empty, zero or non-finite vectors, and null ids, take no part; vectors
are only compared with those of the same length. Rows of the query's own vec_id are no candidates.
A repeated candidate row counts once; a repeated query is answered once. Other columns are ignored. An empty table, or
one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, parts, read, tidy
from .flat import map_arrays, write_arrays
from .vectors import matrix, usable


def build(ids: np.ndarray, v: np.ndarray, leaf: int = 64, seed: int = 8) -> dict:
    """Tree as flat arrays: of nodes the vantage row, the two distances and children (negative: leaf, as -1 - its number), and the leaves' rows."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            leaves.append(rows)
            return -len(leaves)
        vantage = int(rows[rng.integers(len(rows))])
        d = np.sqrt(((v[rows] - v[vantage]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")  # equal distances may fall on either side
        half = len(rows) // 2
        at = len(nodes)
        nodes.append([vantage, float(d[order[half - 1]]), float(d[order[half]]), 0, 0])
        nodes[at][3], nodes[at][4] = grow(rows[order[:half]]), grow(rows[order[half:]])
        return at

    root = grow(np.arange(len(ids)))
    rows = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    cut = np.append(0, np.cumsum([len(x) for x in leaves])).astype(np.int64)
    return {"ids": ids, "v": v.reshape(-1), "root": np.array([root]), "nodes": np.array(nodes, np.float64).reshape(-1), "rows": rows, "cut": cut}


class Best:
    """The k best of each query so far; empty places are infinite."""

    def __init__(self, n: int, k: int):
        self.d, self.i, self.k = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def offer(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        d = np.concatenate([self.d[rows], d], 1)
        i = np.concatenate([self.i[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        order = np.argsort(i, axis=1, kind="stable")
        d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        order = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        self.d[rows], self.i[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def search(tree: dict, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> Best:
    best, ids = Best(len(q), k), tree["ids"]
    v, nodes, rows_of, cut = tree["v"].reshape(len(ids), -1), tree["nodes"].reshape(-1, 5).tolist(), tree["rows"], tree["cut"].tolist()
    own, other = (q**2).sum(1), (v**2).sum(1)

    def look(rows: np.ndarray, leaf: np.ndarray) -> None:
        """Distances by products first; what may be among the best, rounding allowed for, by differences."""
        scale = own[rows][:, None] + other[leaf]
        near = scale - 2 * (q[rows] @ v[leaf].T) <= best.d[rows, -1:] ** 2 * (1 + 1e-9) + 1e-9 * scale
        near &= query_ids[rows][:, None] != ids[leaf]
        some = np.flatnonzero(near.any(1))
        if not len(some):
            return
        i, j = np.nonzero(near[some])
        d = np.full((len(some), len(leaf)), np.inf)
        d[i, j] = np.sqrt(np.cumsum((q[rows[some[i]]] - v[leaf[j]]) ** 2, axis=1)[:, -1])  # summed in order, as plain loops do
        best.offer(rows[some], d, ids[leaf])

    def side(node: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the vantage point, and which of the rows lie nearer to the inner side."""
        d = np.sqrt(((q[rows] - v[int(node[0])]) ** 2).sum(1))
        return d, d <= (node[1] + node[2]) / 2

    def descend(node: int, rows: np.ndarray) -> None:
        """Every query to the leaf on its own side, for a first bound."""
        if not len(rows):
            return
        if node < 0:
            home[rows] = node
            look(rows, rows_of[cut[-1 - node] : cut[-node]])
            return
        _, near = side(nodes[node], rows)
        descend(int(nodes[node][3]), rows[near])
        descend(int(nodes[node][4]), rows[~near])

    def visit(node: int, rows: np.ndarray) -> None:
        """Each leaf once, with all queries that may find something there."""
        if not len(rows):
            return
        if node < 0:
            look(rows[home[rows] != node], rows_of[cut[-1 - node] : cut[-node]])
            return
        d, near = side(nodes[node], rows)
        reach = lambda x: x * factor <= best.d[rows, -1] * (1 + 1e-9) + 1e-12
        visit(int(nodes[node][3]), rows[near | reach(d - nodes[node][1])])
        visit(int(nodes[node][4]), rows[~near | reach(nodes[node][2] - d)])

    if len(ids):
        home, root = np.zeros(len(q), np.int64), int(tree["root"][0])
        descend(root, np.arange(len(q)))
        visit(root, np.arange(len(q)))
    return best


def _tree_file(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        path = write_arrays(folder, build(table.column("vec_id").to_numpy(), matrix(table.column("embedding"))))
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "tree": [path]})

    return run


def _query_file(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        path = write_arrays(folder, {"ids": table.column("vec_id").to_numpy(), "v": matrix(table.column("embedding")).reshape(-1)})
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "queries": [path]})

    return run


def _answers(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = map_arrays(queries)
                query_ids = asked["ids"]
                best = search(map_arrays(tree), query_ids, asked["v"].reshape(len(query_ids), -1), k, factor)
                real = np.isfinite(best.d)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query_ids[:, None], real.shape)[real]), pa.array(best.i[real]), pa.array(best.d[real])], names=["query_id", "vec_id", "score"])
        tidy()

    return run


def nearest(vectors: DataFrame, scratch: Scratch, queries: DataFrame, *, k: int = 10, factor: float = 1.0, shard: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` and ``queries``: (vec_id, embedding)."""

    def clean(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & usable("embedding"))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), "embedding").dropDuplicates(["vec_id", "embedding"])

    rows, asked = scratch.save(clean(vectors), "vectors"), scratch.save(clean(queries), "queries")
    shards, blocks = max(1, -(-rows.count() // shard)), max(1, -(-asked.count() // block))
    folder = f"{scratch.path}/vectors"
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("dims", "shard").applyInArrow(_tree_file(folder), "dims int, shard bigint, tree string")
    trees = scratch.save(trees, "trees")
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).groupBy("dims", "block").applyInArrow(_query_file(folder), "dims int, queries string")
    packed = scratch.save(packed, "blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    tasks = min(4096, max(parts(rows.sparkSession), shards * blocks // 16))  # rows of paths, a tree's side by side
    pairs = trees.join(packed, ["dims", "shard"]).repartition(tasks, "tree", F.pmod(F.xxhash64("queries"), F.lit(16))).sortWithinPartitions("tree")
    found = pairs.select("tree", "queries").mapInArrow(_answers(k, factor), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, Scratch(spark, "op8"), rows.where("vec_id % 100 = 0"))


ORACLE_SQL = r"""WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda x, y: x + y)) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
