"""Exact and probabilistic de-duplication of keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hash functions."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def fnv1a(text: str, seed: int = 0) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = (2166136261 ^ seed) & 0xFFFFFFFF
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist()
    for u in units:
        h = ((h ^ u) * 16777619) & 0xFFFFFFFF
    return h


def bloom_places(keys: pd.Series, bits: int, hashes: int) -> np.ndarray:
    """Bits of every key, a row each: ``fnv1a`` under one seed a hash, all keys a character at a time."""
    raw = [k.encode("utf-16-le") for k in keys]
    size = np.array([len(x) // 2 for x in raw], np.int64)
    units, start = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint32), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    seeds = np.array([(i * 0x9E3779B9) & 0xFFFFFFFF for i in range(hashes)], np.uint32) ^ np.uint32(2166136261)
    h = np.repeat(seeds[None], len(raw), axis=0)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size[order], -t, "left"))  # keys longer than t
        h[:live] = (h[:live] ^ units[start[order[:live]] + t][:, None]) * np.uint32(16777619)
    out = np.empty(h.shape, np.int64)
    out[order] = h.astype(np.int64) % bits
    return out


def bloom_build(df: DataFrame, key: str, capacity: int = 1_000_000, error: float = 0.001, chunk_bits: int = 1 << 16) -> DataFrame:
    """The filter as rows (chunk, bits): each task ors its own chunks and sends at most one row for each, so the size is bounded by the filter's."""
    bits, hashes = bloom_size(capacity, error)

    def local(batches):
        chunks: dict[int, np.ndarray] = {}
        for pdf in batches:
            places = np.unique(bloom_places(pdf[key].dropna(), bits, hashes))
            for c in np.unique(places // chunk_bits).tolist():
                chunks.setdefault(c, np.zeros(chunk_bits, bool))[places[places // chunk_bits == c] % chunk_bits] = True
        yield pd.DataFrame({"chunk": list(chunks), "bits": [np.packbits(c, bitorder="little").tobytes() for c in chunks.values()]}).astype({"chunk": "int32"}) if chunks else pd.DataFrame({"chunk": pd.Series(dtype="int32"), "bits": pd.Series(dtype=object)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [joined.tobytes()]})

    return df.select(key).mapInPandas(local, "chunk int, bits binary").groupBy("chunk").applyInPandas(merge, "chunk int, bits binary")


def bloom_contains(df: DataFrame, key: str, built: DataFrame, capacity: int = 1_000_000, error: float = 0.001, chunk_bits: int = 1 << 16, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """``df`` with ``maybe``: no key of the filter is missed; a null key is none. Capacity and error set the filter's size:
    up to ``broadcast_bytes`` it goes to every task, a larger one meets the keys' bits chunk by chunk."""
    bits, hashes = bloom_size(capacity, error)
    if bits // 8 > broadcast_bytes:
        return _contains_by_chunk(df, key, built, bits, hashes, chunk_bits)
    whole = np.zeros(-(-bits // chunk_bits) * chunk_bits // 8, np.uint8)
    for r in built.collect():
        whole[r["chunk"] * chunk_bits // 8 : (r["chunk"] + 1) * chunk_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        out, some = np.zeros(len(keys), bool), keys.notna().to_numpy()
        places = bloom_places(keys[some], bits, hashes)
        out[some] = (shared.value[places >> 3] >> (places & 7) & 1).all(1)
        return pd.Series(out)

    return df.withColumn("maybe", maybe(F.col(key)))


def _contains_by_chunk(df: DataFrame, key: str, built: DataFrame, bits: int, hashes: int, chunk_bits: int) -> DataFrame:
    """Every distinct key's bits to their chunks and back, so no task holds the filter."""

    @F.pandas_udf("array<bigint>")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series(list(bloom_places(keys, bits, hashes)))

    at = df.select(F.col(key).alias("_k")).where("_k is not null").distinct().select("_k", F.explode(places("_k")).alias("_p"))
    at = at.withColumns({"chunk": F.floor(F.col("_p") / F.lit(chunk_bits)).cast("int"), "_p": F.pmod("_p", F.lit(chunk_bits))})
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("_p") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_b, cast(_p % 8 as int))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = at.join(built, "chunk", "left").withColumn("_b", byte).groupBy("_k").agg(F.bool_and(hit).alias("maybe"))
    return df.join(found, df[key] == found["_k"], "left").select(*[df[c] for c in df.columns], F.coalesce("maybe", F.lit(False)).alias("maybe"))
