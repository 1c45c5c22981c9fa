"""Token counts by offset-mapped attribution, op2.

A whole text is encoded once, so no token differs from those that a model would see. Sections tile
the text: by default lines, each with its closing line feed. Token spans (characters, as the tokenizer's offsets are: a token that
is part of a character spans the whole of it) and section spans are both sorted, so an interval join
by binary search gives each token its first and last section. A token that crosses a border is given by ``rule``:

* ``most``: to the section that holds most of its characters, the earlier one of equals (default);
* ``start``: to the section of its first character;
* ``share``: to every section in proportion to its characters, so counts may be fractions.

The counts of a text's sections add up to its tokens under any rule; ``crossing`` counts the border-crossing tokens that
touch a section. A null or empty text has one empty section without tokens. Repeated rows and null
ids are rows like any other. Strings of special tokens are ordinary text. Other columns are ignored, clashing names among
them. An empty table gives an empty result; a very long text is encoded whole, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, text_chunks

COUNTS = "doc_id bigint, section int, begin bigint, end bigint, tokens double, crossing bigint"
_state: dict = {}


def lines(data: np.ndarray) -> np.ndarray:
    """Borders of the sections of one text, in bytes: 0, after every line feed, the end."""
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)], [len(data)]])


def attribute(begin: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and border-crossing tokens, of each section. Spans are half open; borders ascend and end with the text."""
    n = len(borders) - 1
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(begin):
        return tokens, crossing
    first = np.searchsorted(borders, begin, "right") - 1
    last = np.maximum(first, np.searchsorted(borders, end, "left") - 1)
    first, last = np.minimum(first, n - 1), np.minimum(last, n - 1)
    cross = np.flatnonzero(first < last)
    tokens += np.bincount(first if rule == "start" else np.delete(first, cross), minlength=n)
    for t in cross.tolist():
        own = np.arange(first[t], last[t] + 1)
        held = np.minimum(end[t], borders[own + 1]) - np.maximum(begin[t], borders[own])
        crossing[own] += 1
        if rule == "most":
            tokens[own[held.argmax()]] += 1
        elif rule == "share":
            tokens[own] += held / held.sum()
    return tokens, crossing


def _tokenizer(path: str, pattern: str):
    """Encoder, and bytes of every id."""
    if _state.get("key") != (path, pattern):
        import base64

        import tiktoken

        with open(path, "rb") as lines_:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines_)}
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            width[i] = len(token)
        _state.update(key=(path, pattern), encode=tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, bytes=width)
    return _state["encode"], _state["bytes"]


def _count(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _tokenizer(path, pattern)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                cut = offsets.tolist()
                raw = data.tobytes()
                ids = [encode(raw[a:b].decode()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                rows = [[], [], [], [], [], []]
                for k, (a, b, mine) in enumerate(zip(cut[:-1], cut[1:], ids, strict=True)):
                    text = data[a:b]
                    borders = lines(text)
                    stop = np.cumsum(width[np.array(mine, np.int64)])
                    start = np.append(0, stop[:-1]) if len(stop) else stop
                    chars = np.append(0, np.cumsum((text & 0xC0) != 0x80))
                    tokens, crossing = attribute(np.maximum(chars[np.minimum(start + 1, len(text))] - 1, 0), chars[stop], chars[borders], rule)
                    n = len(tokens)
                    for column, x in zip(rows, (np.full(n, k), np.arange(n), chars[borders[:-1]], chars[borders[1:]], tokens, crossing), strict=True):
                        column.append(x)
                k, section, begin, end, tokens, crossing = map(np.concatenate, rows)
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(k)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([doc, pa.array(section, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens), pa.array(crossing)], names=["doc_id", "section", "begin", "end", "tokens", "crossing"])

    return run


def token_counts(docs: DataFrame, *, path: str, pattern: str, rule: str = "most") -> DataFrame:
    """A row for each section of ``docs(doc_id, text)``. ``path``: ranks of a byte-level tokenizer; ``pattern``: its pre-tokens."""
    return docs.select("doc_id", "text").mapInArrow(_count(path, pattern, rule), COUNTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
