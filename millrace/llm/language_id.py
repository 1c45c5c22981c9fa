"""Language identification with a bidirectional gated recurrent network over bytes, op7.

The network reads the UTF-8 bytes of a whole text forwards and backwards and gives every byte a distribution over
the learned languages; a text's probabilities are the mean over all its bytes. A text is read in segments of ``segment`` bytes
side by side, each with the ``context`` bytes before and after it, so that states have warmed up where a segment's own bytes
begin: the pooled probabilities differ from those of one unbroken reading by about 0.003 (a test holds them against it). It is trained in numpy by
backpropagation through time on a bounded sample: ``sample`` documents (smallest hashes of doc_id,
spread evenly over the languages, one at least of each), every byte of them, in windows of ``window`` bytes.

A null text, or one without a letter, is ``und`` with score 0; so is everything if nothing can be
learned. A text in a language that wasn't learned gets the nearest learned one. Null languages and null ids are never learned
from; of several texts of one doc_id and language the smallest counts. Rows repeat as they do in the input; other columns
are ignored, and pass through with names that stay theirs. Equal probabilities: the first language by name. An empty
table gives an empty result; a very long text is so many segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, free_name, read, start_task, text_chunks, tidy

_HIDDEN = 8


# ---------------------------------------------------------------- the network


def init(classes: int, hidden: int = _HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))  # input weights and biases: one row for each byte
        p["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
    p["w"] = rng.normal(0, hidden**-0.5, (2 * hidden, classes))
    p["c"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _forward(x: np.ndarray, u: np.ndarray, steps: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, lane, hidden) and what the backward pass needs. steps: bytes by time and lane; padding keeps the state."""
    hidden = u.shape[0]
    h, states, tape = np.zeros((steps.shape[1], hidden), x.dtype), [], []
    for t in range(len(steps)):
        a = x[steps[t]]
        r_z = _sigmoid(a[:, : 2 * hidden] + h @ u[:, : 2 * hidden])
        r, z = r_z[:, :hidden], r_z[:, hidden:]
        m = h @ u[:, 2 * hidden :]
        n = np.tanh(a[:, 2 * hidden :] + r * m)
        keep = real[t][:, None]
        new = np.where(keep, n + z * (h - n), h)
        tape.append((h, r, z, m, n, keep))
        h = new
        states.append(h)
    return np.stack(states), tape


def _backward(x: np.ndarray, u: np.ndarray, steps: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of the states, through time."""
    hidden = u.shape[0]
    gx, gu, gh = np.zeros_like(x), np.zeros_like(u), np.zeros_like(tape[0][0])
    for t in range(len(steps) - 1, -1, -1):
        h, r, z, m, n, keep = tape[t]
        gh = gh + grad[t]
        live = gh * keep
        gz, gn = live * (h - n) * z * (1 - z), live * (1 - z) * (1 - n * n)
        gr = gn * m * r * (1 - r)
        ga = np.concatenate([gr, gz, gn], 1)
        np.add.at(gx, steps[t], ga)
        gm = gn * r
        gu[:, : 2 * hidden] += h.T @ ga[:, : 2 * hidden]
        gu[:, 2 * hidden :] += h.T @ gm
        gh = gh * ~keep + live * z + ga[:, : 2 * hidden] @ u[:, : 2 * hidden].T + gm @ u[:, 2 * hidden :].T
    return gx, gu


def loss_and_gradients(p: dict[str, np.ndarray], data: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all real positions, every one labelled with its text's language. data, real: (time, lane)."""
    hf, tf = _forward(p["xf"], p["uf"], data, real)
    hb, tb = _forward(p["xb"], p["ub"], data[::-1], real[::-1])
    h = np.concatenate([hf, hb[::-1]], 2)
    logits = h @ p["w"] + p["c"]
    e = np.exp(logits - logits.max(2, keepdims=True))
    q = e / e.sum(2, keepdims=True)
    count = real.sum()
    loss = -np.log(np.maximum(q[:, np.arange(len(labels)), labels], 1e-12))[real].sum() / count
    g = q.copy()
    g[:, np.arange(len(labels)), labels] -= 1
    g *= real[:, :, None] / count
    gh = g @ p["w"].T
    hidden = p["uf"].shape[0]
    out = {"w": np.einsum("tbh,tbc->hc", h, g), "c": g.sum((0, 1))}
    out["xf"], out["uf"] = _backward(p["xf"], p["uf"], data, tf, gh[:, :, :hidden])
    out["xb"], out["ub"] = _backward(p["xb"], p["ub"], data[::-1], tb, gh[::-1, :, hidden:])
    return float(loss), out


def train_network(windows: list[bytes], labels: np.ndarray, classes: int, *, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled batches."""
    p, rng = init(classes, seed=seed), np.random.default_rng(seed)
    width = max(map(len, windows))
    data, real = np.zeros((width, len(windows)), np.uint8), np.zeros((width, len(windows)), bool)
    for i, w in enumerate(windows):
        data[: len(w), i], real[: len(w), i] = np.frombuffer(w, np.uint8), True
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            lanes = order[a : a + batch]
            step += 1
            _, g = loss_and_gradients(p, data[:, lanes], real[:, lanes], labels[lanes])
            eta = rate * min(1.0, 2 * (1 - (step - 1) / total))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - eta * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Reader:
    """Inference over many segments at once. A sigmoid is taken as a tanh of half the argument; arrays are used again."""

    def __init__(self, p: dict[str, np.ndarray], segment: int = 1024, context: int = 96, lanes: int = 640):
        h = p["uf"].shape[0]
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.h, self.segment, self.context, self.lanes = h, segment, context, lanes
        self.x = [np.ascontiguousarray(p["x" + d] * half) for d in "fb"]
        self.u = [np.ascontiguousarray(p["u" + d] * half) for d in "fb"]
        self.w, self.c = p["w"], p["c"]
        self.states = [np.empty((segment + 2 * context, lanes, h), np.float32) for _ in "fb"]

    def _run(self, d: int, steps: np.ndarray, size: np.ndarray) -> None:
        """Segments lie longest first, so at each time the live lanes are a prefix."""
        h, x, u, out = self.h, self.x[d], self.u[d], self.states[d]
        lanes = steps.shape[1]
        a, b, n = np.empty((lanes, 3 * h), np.float32), np.empty((lanes, 3 * h), np.float32), np.empty((lanes, h), np.float32)
        live = np.searchsorted(-size, -np.arange(len(steps)), "left")  # lanes with size > t
        zero = np.zeros((lanes, h), np.float32)
        for t in range(len(steps)) if d == 0 else range(len(steps) - 1, -1, -1):
            k = live[t]
            if d == 0:
                state = out[t - 1, :k] if t else zero[:k]
            else:  # a lane that ends here starts from zero
                state = zero[:k] if t + 1 == len(steps) else out[t + 1, :k]
                if t + 1 < len(steps) and live[t + 1] < k:
                    out[t + 1, live[t + 1] : k] = 0
            np.take(x, steps[t, :k], axis=0, out=a[:k])
            np.matmul(state, u, out=b[:k])
            gates = a[:k, : 2 * h]
            gates += b[:k, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            m = n[:k]
            np.multiply(gates[:, :h], b[:k, 2 * h :], out=m)
            m += a[:k, 2 * h :]
            np.tanh(m, out=m)
            new = out[t, :k]
            np.subtract(state, m, out=new)
            new *= gates[:, h:]
            new += m

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over the bytes of each text; zeros for an empty one."""
        size = np.diff(offsets)
        count = -(-size // self.segment)
        doc = np.repeat(np.arange(len(size)), count)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * self.segment
        own = np.minimum(self.segment, size[doc] - first)
        before = np.minimum(first, self.context)
        length = np.minimum(before + own + self.context, size[doc] - first + before)
        start = offsets[:-1][doc] + first - before
        order = np.argsort(-length, kind="stable")
        total = np.zeros((len(size), len(self.c)))
        for a in range(0, len(order), self.lanes):
            pick = order[a : a + self.lanes]
            ln, begin, end = length[pick], before[pick], (before + own)[pick]
            span = np.minimum(start[pick] + np.arange(ln[0])[:, None], max(0, len(data) - 1))
            steps = data[span]
            for d in (0, 1):
                self._run(d, steps, ln)
            sums = np.zeros((len(pick), len(self.c)))
            live = np.searchsorted(-ln, -np.arange(ln[0]), "left")
            h = self.h
            for t in range(int(ln[0])):
                k = live[t]
                counts = (begin[:k] <= t) & (t < end[:k])
                if not counts.any():
                    continue
                e = self.states[0][t, :k] @ self.w[:h]
                e += self.states[1][t, :k] @ self.w[h:]
                e += self.c
                np.exp(e, out=e)
                e /= e @ np.ones((e.shape[1], 1), np.float32)
                if not counts.all():
                    e *= counts[:, None]
                sums[:k] += e
            np.add.at(total, doc[pick], sums)
        return total / np.maximum(size, 1)[:, None]


# ---------------------------------------------------------------- the operator


def train(docs: DataFrame, *, sample: int = 400, window: int = 128, epochs: int = 3, batch: int = 128) -> dict | None:
    """Model of every language of ``docs(doc_id, text, lang)``, or None if no text has a language."""
    known = docs.where(fold("doc_id", 4) != 2).where("lang is not null and doc_id is not null and length(text) > 0")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # the labels: a value each
    if not langs:
        return None
    each = -(-sample // len(langs))
    # the smallest hashes of a language: of 64 parts of it first, so that a third of all rows are no single task
    ids = known.select("lang", "doc_id").distinct().withColumns({"h": F.xxhash64("doc_id"), "part": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))})
    for by in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id"))).where(F.col("n") <= each).drop("n")
    # sample ids and one more a language at most: a bounded side
    rows = known.select("lang", "doc_id", "text").join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"])
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).toArrow().to_pylist()
    place, cuts, labels = {lang: i for i, lang in enumerate(langs)}, [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        raw = r["text"].encode()
        cuts += [raw[a : a + window] for a in range(0, len(raw), window)]
        labels += [place[r["lang"]]] * (len(cuts) - len(labels))
    return {"langs": langs, "net": train_network(cuts, np.array(labels), len(langs), epochs=epochs, batch=batch)}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs(text, ...)`` and, as the last two columns, ``lang_pred`` and ``lang_score`` (with underscores before them where a name is taken)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = [free_name(docs, "lang_pred"), free_name(docs, "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        start_task()
        letter = regex.compile(r"\p{L}")
        m = shared.value
        reader = Reader(m["net"]) if m else None
        for batch in batches:
            pred, score = [], []
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                p = reader.probabilities(data, offsets) if m else np.zeros((hi - lo, 1))
                best = p.argmax(1)
                for i, text in enumerate(batch.column(at).slice(lo, hi - lo)):
                    known = m and text.is_valid and letter.search(text.as_py())
                    pred.append(m["langs"][best[i]] if known else "und")
                    score.append(float(min(1.0, p[i, best[i]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])
        del reader
        tidy()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
