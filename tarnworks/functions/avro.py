"""Avro-like binary records: schema resolution, compatibility and a codec for columns.

Schemas are JSON-like: a type name, or a dict with type record (name, fields), array (items), map (values), enum (symbols) or
fixed (size), or a list for a union.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a written type may be read as, besides itself.
PROMOTIONS = {"int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"]}


class SchemaError(ValueError):
    pass


def kind_of(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema["type"] if isinstance(schema, dict) else schema


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("bigint")))


def _put_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _get_long(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return (n >> 1) ^ -(n & 1), at


def _fits(schema: Any, value: Any) -> bool:
    kind = kind_of(schema)
    whole = isinstance(value, int) and not isinstance(value, bool)
    return {"null": value is None, "boolean": isinstance(value, bool), "int": whole and -(2**31) <= value < 2**31, "long": whole and -(2**63) <= value < 2**63, "float": isinstance(value, float), "double": isinstance(value, float), "string": isinstance(value, str), "bytes": isinstance(value, bytes), "record": isinstance(value, dict), "map": isinstance(value, dict), "array": isinstance(value, list), "enum": isinstance(value, str), "fixed": isinstance(value, bytes)}[kind]


def encode(schema: Any, value: Any, out: bytearray | None = None) -> bytearray:
    out = bytearray() if out is None else out
    kind = kind_of(schema)
    if kind == "union":
        for i, branch in enumerate(schema):
            if _fits(branch, value):
                _put_long(out, i)
                return encode(branch, value, out)
        raise SchemaError(f"no branch for {value!r}")
    if kind in ("int", "long"):
        if not _fits(kind, value):
            raise SchemaError(f"{value!r} is no {kind}")
        _put_long(out, value)
    elif kind == "boolean":
        out.append(bool(value))
    elif kind in ("float", "double"):
        out += struct.pack("<f" if kind == "float" else "<d", value)
    elif kind in ("string", "bytes"):
        raw = value.encode() if kind == "string" else value
        _put_long(out, len(raw))
        out += raw
    elif kind == "record":
        for f in schema["fields"]:
            if f["name"] not in value and "default" not in f:
                raise SchemaError(f"{f['name']} is missing")
            encode(f["type"], value.get(f["name"], f.get("default")), out)
    elif kind == "array":
        if value:
            _put_long(out, len(value))
            for x in value:
                encode(schema["items"], x, out)
        _put_long(out, 0)
    elif kind == "map":
        if value:
            _put_long(out, len(value))
            for k, x in value.items():
                encode("string", k, out)
                encode(schema["values"], x, out)
        _put_long(out, 0)
    elif kind == "enum":
        _put_long(out, schema["symbols"].index(value))
    elif kind == "fixed":
        if len(value) != schema["size"]:
            raise SchemaError("wrong size")
        out += value
    elif kind != "null":
        raise SchemaError(f"unknown type {kind}")
    return out


def readable(writer: Any, reader: Any) -> list[str]:
    """Why data written by one schema can't be read by another; empty if it can. Every branch of a written union must be readable."""
    w, r = kind_of(writer), kind_of(reader)
    if w == "union":
        return [e for branch in writer for e in readable(branch, reader)]
    if r == "union":
        return [] if any(not readable(writer, b) for b in reader) else [f"no branch reads {w}"]
    if w != r:
        return [] if r in PROMOTIONS.get(w, []) else [f"{w} is not read as {r}"]
    if w == "record":
        if writer.get("name") != reader.get("name"):
            return [f"{writer.get('name')} is not {reader.get('name')}"]
        written = {f["name"]: f["type"] for f in writer["fields"]}
        return [e for f in reader["fields"] for e in (readable(written[f["name"]], f["type"]) if f["name"] in written else [] if "default" in f else [f"{f['name']} has no default"])]
    if w == "array":
        return readable(writer["items"], reader["items"])
    if w == "map":
        return readable(writer["values"], reader["values"])
    if w == "enum":
        return [] if set(writer["symbols"]) <= set(reader["symbols"]) or "default" in reader else ["unknown symbols"]
    return [] if w != "fixed" or writer["size"] == reader["size"] else ["sizes differ"]


def decode(data: memoryview, writer: Any, reader: Any = None, at: int = 0) -> tuple[Any, int]:
    """(value, where it ends) of data written by one schema and read by another."""
    reader = writer if reader is None else reader
    kind = kind_of(writer)
    if kind == "union":
        i, at = _get_long(data, at)
        return decode(data, writer[i], reader, at)
    if kind_of(reader) == "union":
        reader = next((b for b in reader if kind_of(b) == kind and not readable(writer, b)), None) or next((b for b in reader if not readable(writer, b)), None)
        if reader is None:
            raise SchemaError(f"no branch reads {kind}")
    if kind == "null":
        return None, at
    if kind == "boolean":
        return data[at] != 0, at + 1
    if kind in ("int", "long"):
        n, at = _get_long(data, at)
        return (float(n) if kind_of(reader) in ("float", "double") else n), at
    if kind in ("float", "double"):
        size = 4 if kind == "float" else 8
        return struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0], at + size
    if kind in ("string", "bytes"):
        n, at = _get_long(data, at)
        raw = bytes(data[at : at + n])
        return (raw.decode() if kind == "string" else raw), at + n
    if kind == "fixed":
        return bytes(data[at : at + writer["size"]]), at + writer["size"]
    if kind == "enum":
        i, at = _get_long(data, at)
        symbol = writer["symbols"][i]
        if symbol not in reader["symbols"]:
            if "default" not in reader:
                raise SchemaError(f"unknown symbol {symbol}")
            symbol = reader["default"]
        return symbol, at
    if kind == "record":
        wanted = {f["name"]: f for f in reader["fields"]}
        out = {}
        for f in writer["fields"]:
            own = wanted.get(f["name"])
            x, at = decode(data, f["type"], own["type"] if own else None, at)
            if own:
                out[f["name"]] = x
        for name, f in wanted.items():
            if name not in out:
                if "default" not in f:
                    raise SchemaError(f"{name} has no default")
                out[name] = f["default"]
        return out, at
    items: Any = [] if kind == "array" else {}
    while True:
        n, at = _get_long(data, at)
        if n == 0:
            return items, at
        if n < 0:
            n = -n
            _, at = _get_long(data, at)
        for _ in range(n):
            if kind == "array":
                x, at = decode(data, writer["items"], reader["items"], at)
                items.append(x)
            else:
                k, at = decode(data, "string", None, at)
                items[k], at = decode(data, writer["values"], reader["values"], at)


def encode_rows(df: DataFrame, schema: dict, name: str = "encoded") -> DataFrame:
    """One binary column of df's rows as records of the schema."""
    fields = [f["name"] for f in schema["fields"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            yield pd.DataFrame({name: [bytes(encode(schema, r)) for r in rows]})

    return df.select(*fields).mapInPandas(run, f"{name} binary")


def decode_rows(df: DataFrame, writer: dict, reader: dict, ddl: str, name: str = "encoded") -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([decode(memoryview(x), writer, reader)[0] for x in frame[name]], columns=[f["name"] for f in reader["fields"]])

    return df.select(name).mapInPandas(run, ddl)


class SchemaRegistry:
    """Schemas by id from 1; a subject takes only schemas that read what its latest one wrote."""

    def __init__(self) -> None:
        self.schemas: list[Any] = []
        self.subjects: dict[str, list[int]] = {}

    def register(self, schema: Any, subject: str | None = None) -> int:
        known = self.subjects.setdefault(subject, []) if subject else []
        if known and (errors := readable(self.get(known[-1]), schema)):
            raise SchemaError("; ".join(errors))
        if schema not in self.schemas:
            self.schemas.append(schema)
        i = self.schemas.index(schema) + 1
        if subject:
            known.append(i)
        return i

    def get(self, i: int) -> Any:
        return self.schemas[i - 1]

    def encode_with_id(self, i: int, value: Any) -> bytes:
        return i.to_bytes(4, "big") + bytes(encode(self.get(i), value))

    def decode_with_id(self, data: bytes, reader: Any = None) -> Any:
        return decode(memoryview(data)[4:], self.get(int.from_bytes(data[:4], "big")), reader)[0]
