"""Language-model scores from an Elias-Fano n-gram trie, op9.

Level 1 holds every training token (whole keys, sorted by their hashes; counts), level 2 every pair of neighbours and
level 3 every triple. Levels 2 and 3 are dealt to shards by the first word, hot first words over several
shards. A shard is one flat file that the tasks memory-map: the first words present; for each of the two levels an
Elias-Fano sequence of pointers to a parent's range of successors, the successors, and 8-bit codes of
smoothed log probabilities; and a code for the back-off of each pair. Successors are stored relative to
their context: each range is raised by the last value of the range before it, which makes a whole
level one monotone sequence. A look-up finds the context, reads two pointers and the base, and makes one
successor search inside the range; the pair found is the context of the next word's triple.

Smoothing (Dirichlet, at each level): P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu), P(w | uv) = (c(uvw) + mu P(w | v)) / (c(uv) + mu). What isn't
in a level adds nothing there. A text starts after an ``end``, so its first word has a pair and no triple.
Codes stand for the mean of their bin, of 256 equally wide ones.

Counting packs sorted words and triples in compressed blobs, dealt by hash, so a very common pair is one entry a blob. Every token, pair and
triple of the training texts is kept: nothing is pruned. The trie files lie in the shared folder; where
that is not a mounted path, a task copies a file to its own folder, maps it and unlinks it.

A null or empty text has the ``end`` token only. A null doc_id is scored and counts as held out.
Rows repeat as they do in the input and in training. With no training text all counts are 0. Other columns are ignored.
An empty table gives an empty result; a very long text is one sequence like any other. Words have 32-bit identifiers,
so training raises an error at 2^32 - 1 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, factorize, first_places, fold, key_hash, mix, parts, read, spans, text_chunks, tidy, word_keys
from .elias_fano import EliasFano, build
from .flat import map_arrays, write_arrays



# ---------------------------------------------------------------- blobs


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, compressed."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(-1))
        at += n * w
    return out


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))


def _deal(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows already in order of bucket."""
    cut = _cuts(bucket)
    blobs = [_squeeze([c[a:b] for c in columns]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two columns) of all tokens of the texts, each text closed by ``end``, whose key is zero as no word's is, and where texts begin."""
    starts, ends = spans(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    cut = np.append(0, np.cumsum(np.bincount(owner, minlength=n) + 1))
    out = np.zeros((2, int(cut[-1])), np.uint64)
    out[:, np.arange(len(starts)) + owner] = word_keys(data, starts, ends)
    return out, cut


def _batches_of_tokens(batches: Iterator[pa.RecordBatch], least: int = 1 << 20) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            held.append(_tokens(data, offsets)[0])
            size += held[-1].shape[1]
            if size >= least:
                yield np.concatenate(held, 1)
                held, size = [], 0
    if held:
        yield np.concatenate(held, 1)
    held = []
    tidy()


# ---------------------------------------------------------------- level 1


def _hash(keys: np.ndarray, hash_bits: int) -> np.ndarray:
    """Hashes of keys; words of one hash are told apart by their keys (fewer bits only make more of them)."""
    return key_hash(*keys) << np.uint64(64 - hash_bits)


def _sorted_words(keys: np.ndarray, hash_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order of hash and key: hashes, keys, and the code of each word given."""
    code, first = factorize(*keys)
    keys = keys[:, first]
    h = _hash(keys, hash_bits)
    order = np.lexsort((*keys, h)) if hash_bits < 64 else np.argsort(h)
    if hash_bits == 64 and (np.diff(h[order]) == 0).any():
        order = np.lexsort((*keys, h))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return h[order], keys[:, order], back[code]


def _count_words(bits: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _batches_of_tokens(batches):
            h, keys, code = _sorted_words(tokens, hash_bits)
            yield _deal((h >> np.uint64(64 - bits)).astype(np.int64), [*keys, np.bincount(code).astype("<u4")])

    return run


def _level_one(folder: str, hash_bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi, c = (np.concatenate(x) for x in zip(*(_expand(b, ["<u8", "<u8", "<u4"]) for b in table.column("blob").to_pylist()), strict=True))
        h, keys, code = _sorted_words(np.stack([lo, hi]), hash_bits)
        c = np.bincount(code, weights=c).astype(np.int64)
        longest = int(np.diff(_cuts(h)).max())
        path = write_arrays(folder, {"hash": h, "lo": keys[0], "hi": keys[1], "count": c, "longest": np.array([longest])})
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "path": [path], "n": pa.array([len(h)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})

    return run


class Words:
    """Level 1 over its files: identifiers are places in the order of hashes."""

    def __init__(self, files: list[tuple[int, str, int]], bits: int, hash_bits: int):
        self.bits, self.hash_bits, self.paths, self.base = bits, hash_bits, {b: p for b, p, _ in files}, {}
        total = 0
        for b, _, n in sorted(files):
            self.base[b] = total
            total += n
        self.starts = np.array([self.base[b] for b in sorted(self.base)], np.int64)
        self.order = sorted(self.base)

    def look_up(self, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers (-1: unknown) and counts of words in order of hash."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if len(h):
            bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
            cut = _cuts(bucket)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = int(bucket[a])
                if k in self.paths:
                    arrays = map_arrays(self.paths[k])
                    last = len(arrays["hash"]) - 1
                    begin = np.searchsorted(arrays["hash"], h[a:b])
                    for step in range(int(arrays["longest"][0])):
                        place = np.minimum(begin + step, last)
                        hit = (arrays["lo"][place] == keys[0, a:b]) & (arrays["hi"][place] == keys[1, a:b])
                        ids[a:b][hit], counts[a:b][hit] = place[hit] + self.base[k], arrays["count"][place[hit]]
        return ids, counts

    def end(self) -> tuple[int, int]:
        """Identifier and count of ``end``."""
        keys = np.zeros((2, 1), np.uint64)
        ids, counts = self.look_up(_hash(keys, self.hash_bits), keys)
        return int(ids[0]), int(counts[0])

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted identifiers."""
        out = np.zeros(len(ids), np.int64)
        if len(ids):
            file = np.searchsorted(self.starts, ids, "right") - 1
            cut = _cuts(file)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = self.order[int(file[a])]
                out[a:b] = map_arrays(self.paths[k])["count"][ids[a:b] - self.base[k]]
        return out

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, keys, code = _sorted_words(tokens, self.hash_bits)
        ids, counts = self.look_up(h, keys)
        return ids[code], counts[code]


# ---------------------------------------------------------------- levels 2 and 3

_NONE = 0xFFFFFFFF


def shard_of(first: np.ndarray, second: np.ndarray, first_count: np.ndarray, shards: int, spread: int) -> np.ndarray:
    """A first word has one shard more for every ``spread`` times that it occurs."""
    ways = 1 + np.minimum(shards - 1, first_count // spread)
    a, b = mix(first.astype(np.uint64) + np.uint64(1)) >> np.uint64(8), mix(second.astype(np.uint64) ^ np.uint64(0xABCDEF)) >> np.uint64(8)
    return ((a + b % ways.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _before(x: np.ndarray, at_start) -> np.ndarray:
    """The value one place before; a text's last token is END, so the next text starts after it."""
    out = np.empty_like(x)
    out[0] = at_start
    out[1:] = x[:-1]
    return out


def _count_triples(make: tuple, shards: int, spread: int):
    """Each token with the one before it and the one after it; an END has none after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(*make)
        end_id, end_count = level.end()
        for tokens in _batches_of_tokens(batches):
            ids, counts = level.encode(tokens)
            first, first_count = _before(ids, end_id), _before(counts, end_count)
            third = np.append(ids[1:], _NONE)
            third[tokens[1] == 0] = _NONE
            pair_code, pair = pd.factorize((first << 32 | ids).astype(np.uint64))
            at = first_places(pair_code, len(pair))
            shard = shard_of(first[at], ids[at], first_count[at], shards, spread)
            rank = np.empty(len(pair), np.int64)
            rank[np.lexsort((pair, shard))] = np.arange(len(pair))
            code, distinct = pd.factorize((rank[pair_code] << 32 | third).astype(np.uint64))
            n, order = np.bincount(code), np.argsort(distinct)
            distinct, n = distinct[order], n[order].astype("<u4")
            back = np.empty(len(pair), np.int64)
            back[rank] = np.arange(len(pair))
            own = back[(distinct >> np.uint64(32)).astype(np.int64)]
            one, dealt = (pair[own] >> np.uint64(32)).astype("<u4"), shard[own]
            step = np.diff(one, prepend=np.uint32(0))
            starts = _cuts(dealt)[:-1]
            step[starts] = one[starts]
            yield _deal(dealt, [step, (pair[own] & np.uint64(_NONE)).astype("<u4"), (distinct & np.uint64(_NONE)).astype("<u4"), n])

    return run


def alone(counts, total: int, distinct: int):
    return (counts + 0.1) / (total + 0.1 * (distinct + 1))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of numbers, and the mean of each code's."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256)
    low, high = x.min(), x.max()
    code = np.minimum(255, (x - low) * (256 / max(1e-9, high - low))).astype(np.uint8)
    return code, np.bincount(code, weights=x, minlength=256) / np.maximum(np.bincount(code, minlength=256), 1)


def _ranges(cut: np.ndarray, values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Pointers to ranges, and values relative to their range's context, both monotone. cut: bounds of the ranges; some may be empty."""
    size = np.diff(cut)
    last = np.where(size > 0, values[np.maximum(cut[1:] - 1, 0)] + 1, 0) if len(values) else np.zeros(len(size), np.int64)
    base = np.append(0, np.cumsum(last)[:-1]) if len(size) else last
    out = {}
    for kind, x in (("pointer", cut), ("child", values + np.repeat(base, size))):
        out |= {f"{name}{kind}.{k}": v for k, v in build(x).items()}
    return out


def build_shard(first: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray, level, total: int, distinct: int, mu: float) -> dict[str, np.ndarray]:
    """Flat arrays of one shard from its distinct triples in order; a third word of _NONE counts for the pair only."""
    pair_cut = _cuts(first << 32 | second)
    begin = pair_cut[:-1]
    pairs, one, two = np.add.reduceat(n, begin), first[begin], second[begin]
    ids, code = np.unique(two, return_inverse=True)
    second_count = level.counts(ids)[code]
    log_p = np.log10((pairs + mu * alone(second_count, total, distinct)) / (level.counts(one) + mu))
    real = third != _NONE
    owner = np.repeat(np.arange(len(begin)), np.diff(pair_cut))[real]
    one_cut = _cuts(one)
    arrays = {"context": one[one_cut[:-1]].astype("<u4")}
    arrays["code2"], arrays["book2"] = _codes(log_p)
    arrays["code_back"], arrays["book_back"] = _codes(np.log10(mu / (pairs + mu)))
    arrays["code3"], arrays["book3"] = _codes(np.log10(n[real] / (pairs[owner] + mu)))
    arrays |= _ranges(one_cut, two, "2")
    return arrays | _ranges(np.append(0, np.cumsum(np.bincount(owner, minlength=len(begin)))), third[real], "3")


def _sequences(arrays: dict[str, np.ndarray], name: str) -> tuple[EliasFano, EliasFano]:
    return tuple(EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(name + kind)}) for kind in ("pointer", "child"))


def successor(arrays: dict[str, np.ndarray], name: str, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place of a word among the successors of a parent, or -1."""
    pointer, child = _sequences(arrays, name)
    if not child.n:
        return np.full(len(parent), -1, np.int64)
    own = np.append(True, parent[1:] != parent[:-1])  # parents come in order, so each is read once
    turn, parent = np.cumsum(own) - 1, parent[own]
    begin, end = pointer.get(parent), pointer.get(parent + 1)
    base = np.where(begin > 0, child.get(np.maximum(begin - 1, 0)) + 1, 0)
    begin, end, base = begin[turn], end[turn], base[turn]
    return child.find(base + word, begin, end)


def query_pairs(arrays: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Nodes of pairs, -1 where the shard has none."""
    out = np.full(len(first), -1, np.int64)
    context = arrays["context"]
    at = np.minimum(np.searchsorted(context, first.astype(np.uint32)), len(context) - 1)
    some = np.flatnonzero(context[at] == first)
    if len(some):
        out[some] = successor(arrays, "2", at[some], second[some])
    return out


def _level_files(folder: str, make: tuple, total: int, distinct: int, mu: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level, columns = Words(*make), []
        for b in table.column("blob").to_pylist():
            step, second, third, n = _expand(b, ["<u4", "<u4", "<u4", "<u4"])
            columns.append((np.cumsum(step, dtype=np.uint64) << np.uint64(32) | second, third, n))
        pair, third, n = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        code, pairs = pd.factorize(pair)
        order = np.argsort(pairs)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        both = rank[code] << np.uint64(32) | third
        pairs = pairs[order]
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order].astype(np.int64)
        cut = _cuts(both)
        both, n = both[cut[:-1]], np.add.reduceat(n, cut[:-1])
        pair = pairs[(both >> np.uint64(32)).astype(np.int64)]
        first, second, third = ((x & np.uint64(_NONE)).astype(np.int64) for x in (pair >> np.uint64(32), pair, both))
        path = write_arrays(folder, build_shard(first, second, third, n, level, total, distinct, mu))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "path": [path], "n": pa.array([len(both)], pa.int64())})

    return run


# ---------------------------------------------------------------- the operator


def train(texts: DataFrame, scratch: Scratch, *, mu: float = 100.0, spread: int = 1 << 16, per_shard: int = 1 << 22, hash_bits: int = 64) -> dict:
    """Trie of ``texts(text)``: paths and sizes of its files, totals. A shard gets about ``per_shard`` training tokens."""
    spark = texts.sparkSession
    bits = max(6, (parts(spark) - 1).bit_length())
    folder = f"{scratch.path}/trie"
    text = texts.select("text")
    counted = text.mapInArrow(_count_words(bits, hash_bits), "bucket int, blob binary").groupBy("bucket").applyInArrow(_level_one(folder, hash_bits), "bucket int, path string, n bigint, total bigint")
    files = scratch.save(counted, "level1").collect()  # one row a file
    make = ([(r["bucket"], r["path"], r["n"]) for r in files], bits, hash_bits)
    total, distinct = sum(r["total"] for r in files), sum(r["n"] for r in files)
    if distinct >= _NONE:
        raise OverflowError(f"{distinct} distinct words: identifiers have 32 bits")
    shards = 1 << max(bits, (max(1, total // per_shard) - 1).bit_length())
    triples = text.mapInArrow(_count_triples(make, shards, spread), "bucket int, blob binary").groupBy("bucket").applyInArrow(_level_files(folder, make, total, distinct, mu), "shard int, path string, n bigint")
    paths = {r["shard"]: r["path"] for r in scratch.save(triples, "levels").collect()}
    return {"words": make, "total": total, "distinct": distinct, "mu": mu, "spread": spread, "shards": shards, "paths": paths}


def _by_shard(shard: np.ndarray, then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((then, shard))
    cut = _cuts(shard[order]) if len(order) else np.zeros(1, int)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(shard[order[lo]]), order[lo:hi]


def score_tokens(model: dict, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of texts that END closes: count, log10 of its base probability, log10 P after its neighbours."""
    level, total, distinct, mu = Words(*model["words"]), model["total"], model["distinct"], model["mu"]
    ids, counts = level.encode(tokens)
    end_id, end_count = level.end()
    first, first_count = _before(ids, end_id), _before(counts, end_count)
    base = alone(counts, total, distinct)
    p = mu * base / (first_count + mu)
    known = np.flatnonzero((ids >= 0) & (first >= 0))
    code, pair = pd.factorize((first[known] << 32 | ids[known]).astype(np.uint64))
    a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(_NONE)).astype(np.int64)
    shard = shard_of(a, b, first_count[known][first_places(code, len(pair))], model["shards"], model["spread"]) if len(pair) else np.zeros(0, np.int64)
    node, pair_p, back = np.full(len(pair), -1, np.int64), np.zeros(len(pair)), np.ones(len(pair))
    for k, rows in _by_shard(shard, pair):
        if k in model["paths"]:
            arrays = map_arrays(model["paths"][k])
            node[rows] = query_pairs(arrays, a[rows], b[rows])
            hit = rows[node[rows] >= 0]
            pair_p[hit], back[hit] = 10 ** arrays["book2"][arrays["code2"][node[hit]]], 10 ** arrays["book_back"][arrays["code_back"][node[hit]]]
    p[known] = np.where(node[code] >= 0, pair_p[code], p[known])

    own = np.full(len(ids), -1, np.int64)
    own[known] = np.where(node[code] >= 0, code, -1)
    above = _before(own, -1)
    above[1:][tokens[1, :-1] == 0] = -1
    deep = np.flatnonzero(above >= 0)
    p[deep] *= back[above[deep]]
    deep = deep[ids[deep] >= 0]
    code, triple = pd.factorize((above[deep] << 32 | ids[deep]).astype(np.uint64))
    parent, word = (triple >> np.uint64(32)).astype(np.int64), (triple & np.uint64(_NONE)).astype(np.int64)
    more = np.zeros(len(triple))
    for k, rows in _by_shard(shard[parent], node[parent]):
        arrays = map_arrays(model["paths"][k])
        found = successor(arrays, "3", node[parent[rows]], word[rows])
        hit = found >= 0
        more[rows[hit]] = 10 ** arrays["book3"][arrays["code3"][found[hit]]]
    p[deep] += more[code]
    return counts, np.log10(base), np.log10(p)


def _score(shared, least: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def out(ids: list, held: list) -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held], 1)
            size = np.concatenate([np.diff(c) for _, c in held])
            counts, base, log_p = score_tokens(model, tokens)
            begin = np.cumsum(size) - size
            columns = [size, np.add.reduceat((counts > 0).astype(np.int64), begin), np.full(len(size), model["total"]), np.add.reduceat(base, begin), np.add.reduceat(log_p, begin)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        ids, held, n = [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids.append(batch.column(0).slice(lo, hi - lo).cast(pa.int64()))
                held.append(_tokens(data, offsets))
                n += held[-1][0].shape[1]
                if n >= least:
                    yield out(ids, held)
                    ids, held, n = [], [], 0
        if held:
            yield out(ids, held)
        ids, held = [], []
        tidy()

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and totals: a row a file
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 10) != 0), Scratch(spark, "op9"))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
