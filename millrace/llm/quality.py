"""Quality classifier by nearest-neighbour voting over latent-semantic vectors, op1.

Terms of a text are the shapes of its words (case, closing mark, symbols, digits, repetition) and
hashed word identities. Latent-semantic analysis of a labelled sample (log term frequency, inverse
document frequency, truncated SVD) turns them into vectors. The sample's vectors are broadcast; its
size is bounded by ``per_class`` rows for each label (smallest hashes of doc_id first), whatever the table's size. Every document's cosines with
all of them are exact block products; the ``k`` nearest vote with their similarity.

Score: share of the vote for label 1, corrected for the sample's share of each label, so that it
estimates the probability in the labelled rows. A null or empty text has no terms and gets the
labelled rows' own share of label 1. With no labelled rows every score is 0.5; with one label only, that label.
Rows repeat as they do in the input; null ids are never learned from; of several texts of one labelled doc_id the smallest
is learned, of several labels the larger. Of neighbours with equal cosines at the ``k``-th place the first in the model count, which lies
sorted by terms and label. A very long text is one vector like any other; an empty table gives an empty result. Other columns
are ignored, and pass through with names that stay theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, free_name, hash_spans, read, spans, start_task, text_chunks, tidy

_SHAPES, _HASHED = 3 * 6 * 3 * 2 * 2, 512
TERMS = 2 * _SHAPES + _HASHED
_UPPER, _LETTER, _DIGIT, _SYMBOL, _CLOSE = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = 1
for _mark, _kind in ((".", 1), (",", 2), ("!", 3), ("?", 3), (";", 4), (":", 4)):
    _CLOSE[ord(_mark)] = _kind
_CLOSE[(_CLOSE == 0) & (_SYMBOL == 1)] = 5


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of term counts for runs of texts."""
    for lo, hi, data, offsets in text_chunks(column):
        starts, ends = spans(data, offsets)
        key = hash_spans(data, starts, ends)
        doc = np.searchsorted(offsets, starts, "right") - 1
        count = lambda table: (c := np.append(0, np.cumsum(table[data], dtype=np.int32)))[ends] - c[starts]  # noqa: B023, E731
        upper, letter, digit, symbol = count(_UPPER), count(_LETTER), count(_DIGIT), count(_SYMBOL)
        case = np.where((upper > 1) & (2 * upper > letter), 2, np.minimum(upper, 1))
        close = _CLOSE[data[ends - 1]]
        marks = np.minimum(symbol, 2)
        again = np.zeros(len(key), np.int64)
        again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        shape = (((case * 6 + close) * 3 + marks) * 2 + (digit > 0)) * 2 + again
        own = pd.Series(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        seen = own.duplicated().to_numpy() & (ends - starts > 5)
        terms = np.concatenate([shape + seen * _SHAPES, 2 * _SHAPES + (key % np.uint64(_HASHED)).astype(np.int64)])
        rows = np.concatenate([doc, doc])
        yield np.bincount(rows * TERMS + terms, minlength=(hi - lo) * TERMS).reshape(hi - lo, TERMS)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, labels: np.ndarray, shares: dict[int, float], dims: int = 64) -> dict:
    """Model of labelled rows of term counts; ``shares``: of the labels among all labelled rows."""
    present = (counts > 0).sum(0)
    idf = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + 1
    x = _weigh(counts, idf)
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, : min(dims, len(values))].astype(np.float32)
    y = x @ basis
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    weight = np.array([shares[int(c)] / max(1e-9, (labels == c).mean()) for c in labels], np.float32)
    return {"idf": idf, "basis": basis, "vectors": y.astype(np.float32), "labels": labels.astype(np.float32), "weight": weight, "share": float(shares.get(1, 0.0))}


def score(model: dict, counts: np.ndarray, k: int = 15, sharp: float = 8.0) -> np.ndarray:
    y = _weigh(counts, model["idf"]) @ model["basis"]
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    out = np.full(len(y), model["share"])
    k = min(k, len(model["labels"]))
    for a in range(0, len(y), 512):
        cos = y[a : a + 512] @ model["vectors"].T
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cos, top, 1).min(1, keepdims=True)
        for i in np.flatnonzero((cos >= least).sum(1) > k):  # ties at the k-th place: the first rows of the model
            top[i] = np.argsort(-cos[i], kind="stable")[:k]
        w = np.maximum(np.take_along_axis(cos, top, 1), 0.0).astype(np.float64) ** sharp * model["weight"][top] + 1e-12
        out[a : a + 512] = (w * model["labels"][top]).sum(1) / w.sum(1)
    out[counts.sum(1) == 0] = model["share"]
    return np.clip(out, 0.0, 1.0)


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[pa.Table, dict[int, float]]:
    """At most ``per_class`` labelled texts of each label, and each label's share of all labelled rows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(shares.values())
    ids = None
    for label in shares:
        one = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    if ids is None:
        return pa.table({"text": pa.array([], pa.string()), "quality": pa.array([], pa.int32())}), {}
    # at most per_class rows a label and two labels: a bounded side; of repeated ids the smallest text
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality")
    counted = got.mapInArrow(_counted, "terms binary, quality int").toArrow()
    return counted, {k: v / total for k, v in shares.items()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start_task()
    for batch in batches:
        rows = [r.astype("<u4").tobytes() for part in term_counts(batch.column(0)) for r in part]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).cast(pa.int32())], ["terms", "quality"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> dict | None:
    rows, shares = sample(docs, labels, per_class)
    if not rows.num_rows:
        return None
    pairs = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))  # the same model whatever order rows come in
    return fit(np.stack([np.frombuffer(x, "<u4") for x, _ in pairs]), np.array([c for _, c in pairs]), shares)


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs(text, ...)`` and, as the last column, ``quality_score`` (with underscores before it where the name is taken)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    name = free_name(docs, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        m = shared.value
        for batch in batches:
            if m is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = np.concatenate([score(m, part) for part in term_counts(batch.column(at))]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, name])
        tidy()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = classify(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
