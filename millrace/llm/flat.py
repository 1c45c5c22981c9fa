"""Flat files of arrays in the shared folder, memory-mapped by tasks."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyarrow import fs

_maps: dict = {}


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One file: a header of names, types, lengths and places, then the arrays, each on an 8-byte border."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += a.nbytes + -a.nbytes % 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    name = f"{uuid.uuid4().hex}.trie"
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(np.array([len(raw)], np.int64).tobytes() + raw)
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.nbytes else b"")
            out.write(b"\0" * (-a.nbytes % 8))
    return f"{folder}/{name}"


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a worker maps a file once."""
    if uri in _maps:
        return _maps[uri]
    import os
    import tempfile

    if len(_maps) > 20_000:
        _maps.clear()
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        handle, own = tempfile.mkstemp()
        with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
        raw = np.memmap(own, np.uint8, "r")
        os.unlink(own)  # the mapping stays
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    base = 8 + size
    _maps[uri] = {k: np.asarray(raw[base + at : base + at + n * np.dtype(t).itemsize]).view(t) for k, (t, n, at) in head.items()}
    return _maps[uri]
