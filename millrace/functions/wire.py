"""Protobuf wire format and gRPC frames, without a schema. Integers are exact: 64 bits, no wrap at 32."""

from __future__ import annotations

import struct


def encode_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while True:
        byte, value = value & 127, value >> 7
        out.append(byte | (128 if value else 0))
        if not value:
            return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("varint cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & ((1 << 64) - 1), at


def fields(data: bytes, strict: bool = False) -> list[dict]:
    """Fields of a message; a fault ends a lenient reading and raises in a strict one."""
    out, at = [], 0
    try:
        while at < len(data):
            key, at = read_varint(data, at)
            number, kind = key >> 3, key & 7
            if number == 0:
                raise ValueError("field number 0")
            if kind == 0:
                start = at
                value, at = read_varint(data, at)
                raw = data[start:at]
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
                raw = data[at : at + size]
                if len(raw) < size:
                    raise ValueError("fixed field cut off")
                value, at = struct.unpack("<d" if kind == 1 else "<f", raw)[0], at + size
            elif kind == 2:
                size, at = read_varint(data, at)
                raw = data[at : at + size]
                if len(raw) < size:
                    raise ValueError("field cut off")
                value, at = raw, at + size
            else:
                raise ValueError(f"wire type {kind}")
            out.append({"field": number, "wire": kind, "type": field_type(kind, value), "value": value, "raw": raw})
    except ValueError:
        if strict:
            raise
    return out


def mostly_text(raw: bytes) -> bool:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return bool(text) and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.85 * len(text)


def field_type(kind: int, value) -> str:
    if kind == 0:
        return "bool" if value in (0, 1) else "uint32" if value < 1 << 31 else "int64"
    if kind in (1, 5):
        return "double" if kind == 1 else "float"
    if mostly_text(value):
        return "string"
    try:
        return "message" if value and fields(value, strict=True) else "bytes"
    except ValueError:
        return "bytes"


def show(value) -> str:
    return value.decode(errors="replace") if isinstance(value, bytes) else str(value)


def encode(values: dict[int, object]) -> bytes:
    """Ints as varints, floats as doubles, text and bytes length-delimited, lists repeated, dicts nested."""
    out = b""
    for number, value in values.items():
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, bool) or isinstance(v, int):
                out += encode_varint(number << 3) + encode_varint(int(v))
            elif isinstance(v, float):
                out += encode_varint(number << 3 | 1) + struct.pack("<d", v)
            else:
                raw = encode(v) if isinstance(v, dict) else v.encode() if isinstance(v, str) else v
                out += encode_varint(number << 3 | 2) + encode_varint(len(raw)) + raw
    return out


def frame(message: bytes, compressed: bool = False) -> bytes:
    return struct.pack(">BI", compressed, len(message)) + message


def frames(data: bytes, strict: bool = False) -> list[dict]:
    """Length-prefixed messages; a cut-off tail is left out, or raises in a strict reading."""
    out, at = [], 0
    while at + 5 <= len(data):
        flag, size = struct.unpack_from(">BI", data, at)
        if at + 5 + size > len(data):
            break
        out.append({"compressed": bool(flag), "message": data[at + 5 : at + 5 + size]})
        at += 5 + size
    if strict and at != len(data):
        raise ValueError("frame length")
    return out


def infer(samples: list[bytes]) -> list[dict]:
    """Per field of all samples: the widest type (string, message, first seen) and whether it repeats in more than half of them."""
    seen: dict[int, dict] = {}
    for data in samples:
        counts: dict[int, int] = {}
        for f in fields(data):
            counts[f["field"]] = counts.get(f["field"], 0) + 1
            seen.setdefault(f["field"], {"types": [], "twice": 0, "count": 0})["types"].append(f["type"])
        for n, c in counts.items():
            seen[n]["count"] += c
            seen[n]["twice"] += c > 1
    pick = lambda types: next((t for t in ("string", "message") if t in types), types[0])
    return [{"field": n, "type": pick(s["types"]), "count": s["count"], "repeated": s["twice"] * 2 > len(samples)} for n, s in sorted(seen.items())]
