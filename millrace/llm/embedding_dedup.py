"""Embedding near-duplicates by randomised-rotation binary codes, op6.

Every unit vector is turned by one random rotation (seeded, the same everywhere) and kept as its
signs, one bit a dimension, with a stored correction factor f = <code, vector>. For a unit vector x,
<x, code> / f is an unbiased estimate of the cosine; for a pair whose cosine is c its error is
about sqrt(1 - c^2) sqrt((1 - f^2) / f^2 / (D - 1)). So a pair whose estimate lies more than
``sigmas`` such errors below the threshold can be left out, with a confidence that ``sigmas`` sets
(6: about one in 10^9); all others are computed exactly in double precision, and only those with
cosine >= threshold link.

Vectors are compared when label and length are equal. A label's vectors are dealt by hash to blocks
of about ``block``, each a flat file in the shared folder; each pair of blocks is a row with two paths, so a hot label
is many rows and no vector travels again. A task maps both files, reads the codes, and of one block's vectors only those
that the bounds leave in doubt. It returns, for each vector that has links, their number and one edge to the root of
its local component; links are counted slice by slice and never kept. Every pair of a label is estimated: on vectors without
clusters no cheaper test is exact, so the work grows with the square of a label's size (figures in the README).

Null labels, and null, empty, zero or non-finite vectors, link with nothing. Rows that repeat
vec_id, label and vector are one vector and each get its row; rows of one vec_id never link with each
other. A null vec_id links with nothing and is its own component (null). Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, hub_join, parts, read, tidy
from .flat import map_arrays, write_arrays
from .vectors import matrix, usable


def rotation(dims: int, seed: int = 6) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of rotated unit vectors."""
    y = unit @ turn.T
    return np.packbits(y > 0, axis=1), (np.abs(y).sum(1) / np.sqrt(y.shape[1])).astype(np.float32)


def signs(code: np.ndarray, dims: int) -> np.ndarray:
    """Codes as unit vectors of equal steps."""
    return ((np.unpackbits(code, axis=1, count=dims).astype(np.float32) * 2) - 1) / np.float32(np.sqrt(dims))


def candidates(x: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of code) that the confidence bound can't leave out. x: rotated unit vectors."""
    dims = x.shape[1]
    f = np.maximum(factor, 1e-6)
    estimate = (x.astype(np.float32) @ signs(code, dims).T) / f
    error = np.sqrt(np.maximum(0, 1 - threshold**2)) * np.sqrt(np.maximum(0, 1 - f**2) / f**2 / max(1, dims - 1))
    return np.nonzero(estimate >= threshold - sigmas * error - 1e-5)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over links a-b."""
    up = np.arange(n)
    while True:
        new = up.copy()
        np.minimum.at(new, a, up[b])
        np.minimum.at(new, b, up[a])
        np.minimum.at(new, up, new.copy())
        new = new[new]
        if (new == up).all():
            return up
        up = new


def _block_file(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = matrix(table.column("embedding"))
        v = v / np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        code, factor = encode(v, rotation(v.shape[1]))
        path = write_arrays(folder, {"ids": table.column("vec_id").to_numpy(), "factor": factor, "code": code.reshape(-1), "v": v.reshape(-1)})
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([path])], names=["label", "dims", "part", "path"])

    return run


def compare(a: dict, b: dict, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with links, their number, and the smallest id they reach, between two blocks or in one (the same twice)."""
    inside = a is b
    ids = a["ids"] if inside else np.concatenate([a["ids"], b["ids"]])
    v, w = a["v"].reshape(len(a["ids"]), -1), b["v"].reshape(len(b["ids"]), -1)
    code, turn, base = b["code"].reshape(len(w), -1), rotation(v.shape[1]), 0 if inside else len(v)
    links, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for s in range(0, len(v), 256):
        i, j = candidates(v[s : s + 256] @ turn.T, code, b["factor"], threshold, sigmas)
        i += s
        if inside:
            i, j = i[i < j], j[i < j]
        sure = []
        for c in range(0, len(i), 1 << 16):
            p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            ok = (np.einsum("nd,nd->n", v[p], w[q]) >= threshold) & (a["ids"][p] != b["ids"][q])
            sure.append((p[ok], q[ok] + base))
        if sure and (p := np.concatenate([x for x, _ in sure])).size:
            q = np.concatenate([y for _, y in sure])
            links += np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
            up = roots(len(ids), np.concatenate([p, np.arange(len(ids))]), np.concatenate([q, up]))
    some = links > 0
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, up, ids)
    return ids[some], links[some], smallest[up[some]]


def _compare(threshold: float, sigmas: float):
    def run(batches):
        for batch in batches:
            for one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = map_arrays(one)
                found = compare(a, a if one == two else map_arrays(two), threshold, sigmas)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["vec_id", "n", "root"])
        tidy()

    return run


def near_dedup(vectors: DataFrame, scratch: Scratch, *, threshold: float = 0.93, sigmas: float = 6.0, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select("vec_id", "embedding", "label")
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding")).withColumn("vec_id", F.col("vec_id").cast("long")).dropDuplicates(["vec_id", "label", "embedding"])
    good = scratch.save(good.withColumn("dims", F.size("embedding")), "vectors")
    sizes = good.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = scratch.save(sizes.select(F.struct("label", "dims").alias("kind"), "blocks"), "sizes")
    dealt = hub_join(good.withColumn("kind", F.struct("label", "dims")), "kind", sizes).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    files = dealt.select("label", "dims", "part", "vec_id", "embedding").groupBy("label", "dims", "part").applyInArrow(_block_file(f"{scratch.path}/blocks"), f"label {dict(rows.dtypes)['label']}, dims int, part int, path string")
    files = scratch.save(files, "blocks")
    here = files.join(files.groupBy("label", "dims").agg(F.max("part").alias("last")), ["label", "dims"])
    pairs = here.select("label", "dims", F.col("path").alias("one"), F.explode(F.sequence("part", "last")).alias("part")).join(files.withColumnRenamed("path", "two"), ["label", "dims", "part"])
    tasks = min(4096, max(parts(rows.sparkSession), files.count() ** 2 // 32))
    pairs = pairs.select("one", "two").repartition(tasks, "one", "two").sortWithinPartitions("one")
    found = scratch.save(pairs.mapInArrow(_compare(threshold, sigmas), "vec_id bigint, n bigint, root bigint"), "links")
    count = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    group = components(scratch, found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(count, "vec_id", "left").join(group.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "embeddings"), Scratch(spark, "op6"))


ORACLE_SQL = r"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) ON id = vec_id"""
