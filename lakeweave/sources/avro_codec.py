"""Avro container files: enough of the format to read and write manifests on any executor."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

MAGIC = b"Obj\x01"


def _names(schema, known: dict) -> None:
    if isinstance(schema, list):
        for s in schema:
            _names(s, known)
    elif isinstance(schema, dict):
        if schema["type"] in ("record", "fixed", "enum") and "name" in schema:
            known[schema["name"]] = schema
            if "namespace" in schema:
                known[f"{schema['namespace']}.{schema['name']}"] = schema
        for f in schema.get("fields", []):
            _names(f["type"], known)
        for key in ("items", "values"):
            if key in schema:
                _names(schema[key], known)
        if isinstance(schema["type"], (dict, list)):
            _names(schema["type"], known)


class Reader:
    def __init__(self, schema):
        self.schema, self.known = schema, {}
        _names(schema, self.known)

    def long(self, b: io.BytesIO) -> int:
        shift = out = 0
        while True:
            (c,) = b.read(1)
            out |= (c & 0x7F) << shift
            if c < 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def bytes(self, b: io.BytesIO) -> bytes:
        return b.read(self.long(b))

    def blocks(self, b: io.BytesIO) -> Iterator[None]:
        while n := self.long(b):
            if n < 0:
                n = -n
                self.long(b)
            for _ in range(n):
                yield

    def read(self, b: io.BytesIO, schema=None):
        s = self.schema if schema is None else schema
        if isinstance(s, list):
            return self.read(b, s[self.long(b)])
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self.read(b, kind)
        if kind in self.known and not (isinstance(s, dict) and kind in ("record", "fixed", "enum")):
            return self.read(b, self.known[kind])
        match kind:
            case "null":
                return None
            case "boolean":
                return b.read(1) == b"\x01"
            case "int" | "long":
                return self.long(b)
            case "float":
                return struct.unpack("<f", b.read(4))[0]
            case "double":
                return struct.unpack("<d", b.read(8))[0]
            case "bytes":
                return self.bytes(b)
            case "string":
                return self.bytes(b).decode()
            case "fixed":
                return b.read(s["size"])
            case "enum":
                return s["symbols"][self.long(b)]
            case "array":
                return [self.read(b, s["items"]) for _ in self.blocks(b)]
            case "map":
                return {self.bytes(b).decode(): self.read(b, s["values"]) for _ in self.blocks(b)}
            case "record":
                return {f["name"]: self.read(b, f["type"]) for f in s["fields"]}
        raise ValueError(f"Avro type {kind} is not known")


class Writer:
    def __init__(self, schema):
        self.schema, self.known = schema, {}
        _names(schema, self.known)

    def long(self, n: int) -> bytes:
        n = (n << 1) ^ (n >> 63)
        out = bytearray()
        while n > 0x7F:
            out.append((n & 0x7F) | 0x80)
            n >>= 7
        out.append(n)
        return bytes(out)

    def bytes(self, data: bytes) -> bytes:
        return self.long(len(data)) + data

    def write(self, value, schema=None) -> bytes:
        s = self.schema if schema is None else schema
        if isinstance(s, list):
            k = next(i for i, x in enumerate(s) if (x == "null") == (value is None))
            return self.long(k) + self.write(value, s[k])
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self.write(value, kind)
        if kind in self.known and not isinstance(s, dict):
            return self.write(value, self.known[kind])
        match kind:
            case "null":
                return b""
            case "boolean":
                return b"\x01" if value else b"\x00"
            case "int" | "long":
                return self.long(int(value))
            case "float":
                return struct.pack("<f", value)
            case "double":
                return struct.pack("<d", value)
            case "bytes":
                return self.bytes(value)
            case "string":
                return self.bytes(value.encode())
            case "fixed":
                return value
            case "enum":
                return self.long(s["symbols"].index(value))
            case "array":
                return (self.long(len(value)) + b"".join(self.write(v, s["items"]) for v in value) if value else b"") + b"\x00"
            case "map":
                return (self.long(len(value)) + b"".join(self.bytes(k.encode()) + self.write(v, s["values"]) for k, v in value.items()) if value else b"") + b"\x00"
            case "record":
                return b"".join(self.write(value.get(f["name"]), f["type"]) for f in s["fields"])
        raise ValueError(f"Avro type {kind} is not known")


def read_file(data: bytes) -> tuple[dict, list]:
    """Metadata (text where it is text) and records of a container file."""
    b = io.BytesIO(data)
    if b.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    plain = Reader({"type": "map", "values": "bytes"})
    meta = plain.read(b)
    schema = json.loads(meta["avro.schema"])
    codec = meta.get("avro.codec", b"null").decode()
    sync, reader, out = b.read(16), Reader(schema), []
    while b.tell() < len(data):
        n, size = plain.long(b), plain.long(b)
        block = b.read(size)
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec == "zstandard":
            import zstandard

            block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
        elif codec != "null":
            raise ValueError(f"Avro codec {codec} is not known")
        part = io.BytesIO(block)
        out += [reader.read(part) for _ in range(n)]
        if b.read(16) != sync:
            raise ValueError("the Avro file is damaged")
    return {k: v.decode("utf-8", "replace") for k, v in meta.items()}, out


def write_file(schema: dict, records: list, meta: dict[str, str] | None = None, block: int = 1000) -> bytes:
    writer, sync = Writer(schema), os.urandom(16)
    head = {"avro.schema": json.dumps(schema), "avro.codec": "deflate"} | (meta or {})
    out = [MAGIC, Writer({"type": "map", "values": "bytes"}).write({k: v.encode() for k, v in head.items()}), sync]
    for k in range(0, len(records), block):
        part = records[k : k + block]
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = press.compress(b"".join(map(writer.write, part))) + press.flush()
        out += [writer.long(len(part)), writer.long(len(data)), data, sync]
    return b"".join(out)
