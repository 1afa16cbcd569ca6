"""Schemas: one model (Spark types, what formats add in field metadata) and its forms in each format.

Metadata keys of a field: ``field_id``, ``storage_name``, ``kind`` (uuid, enum, fixed,
time_millis, nanos), ``size`` (fixed), ``symbols`` (enum), ``precision`` (millis, micros).
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import types as T

ELEMENT, KEY, VALUE = "_element", "_key", "_value"


class UnsupportedType(ValueError):
    """A type that a format has no form for."""


def children(kind: T.DataType, metadata: dict | None = None) -> list[T.StructField]:
    if isinstance(kind, T.StructType):
        return list(kind.fields)
    if isinstance(kind, T.ArrayType):
        return [T.StructField(ELEMENT, kind.elementType, kind.containsNull)]
    if isinstance(kind, T.MapType):
        return [T.StructField(KEY, kind.keyType, False), T.StructField(VALUE, kind.valueType, kind.valueContainsNull)]
    return []


def flatten(schema: T.StructType) -> list[tuple[str, T.StructField]]:
    """(dotted path, field) of all fields, breadth first."""
    out, queue = [], deque((f.name, f) for f in schema.fields)
    while queue:
        path, f = queue.popleft()
        out.append((path, f))
        queue.extend((f"{path}.{c.name}", c) for c in children(f.dataType))
    return out


def find(schema: T.StructType, path: str) -> T.StructField | None:
    return dict(flatten(schema)).get(path)


def type_name(kind: T.DataType) -> str:
    """The outer type's name, without children."""
    if isinstance(kind, T.StructType):
        return "struct"
    return "array" if isinstance(kind, T.ArrayType) else "map" if isinstance(kind, T.MapType) else kind.simpleString()


def schema_rows(schema: T.StructType) -> list[tuple]:
    """(ordinal, path, type, nullable, field_id) of all fields: the rows of a schema table."""
    return [(k, p, type_name(f.dataType), f.nullable, (f.metadata or {}).get("field_id")) for k, (p, f) in enumerate(flatten(schema))]


# Delta: Spark's own JSON; generated columns aren't columns of the table.

GENERATION = "delta.generationExpression"
DELTA_ID, DELTA_NAME = "delta.columnMapping.id", "delta.columnMapping.physicalName"


def to_delta(schema: T.StructType) -> str:
    def field(f: T.StructField) -> T.StructField:
        m = dict(f.metadata or {})
        if "field_id" in m:
            m[DELTA_ID] = m.pop("field_id")
        if "storage_name" in m:
            m[DELTA_NAME] = m.pop("storage_name")
        return T.StructField(f.name, kind(f.dataType), f.nullable, m)

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([field(f) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(kind(t.keyType), kind(t.valueType), t.valueContainsNull)
        if isinstance(t, (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            raise UnsupportedType(t.simpleString())
        return t

    return kind(schema).json()


def from_delta(text: str, keep_generated: bool = False) -> T.StructType:
    def field(f: T.StructField) -> T.StructField:
        m = dict(f.metadata or {})
        if DELTA_ID in m:
            m["field_id"] = m.pop(DELTA_ID)
        if DELTA_NAME in m:
            m["storage_name"] = m.pop(DELTA_NAME)
        return T.StructField(f.name, kind(f.dataType), f.nullable, m)

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([field(f) for f in t.fields if keep_generated or GENERATION not in (f.metadata or {})])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(kind(t.keyType), kind(t.valueType), t.valueContainsNull)
        return t

    return kind(T.StructType.fromJson(json.loads(text)))


# Iceberg: ids are given level by level, new ones above the largest there is.

_ICEBERG = {"boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType, "date": T.DateType, "timestamptz": T.TimestampType, "timestamp": T.TimestampNTZType}


def _ids(schema: T.StructType) -> Iterator[int]:
    yield from (f.metadata["field_id"] for _, f in flatten(schema) if "field_id" in (f.metadata or {}))


def to_iceberg(schema: T.StructType, schema_id: int = 0, identifiers: list[str] | None = None, known: dict[str, int] | None = None) -> dict:
    """``known``: ids that paths have in the table already; they stay."""
    known = known or {}
    last = max([0, *_ids(schema), *known.values()])

    def fresh(path: str, metadata: dict | None) -> int:
        nonlocal last
        if "field_id" in (metadata or {}):
            return metadata["field_id"]
        if path in known:
            return known[path]
        last += 1
        return last

    def struct(t: T.StructType, path: str) -> dict:
        ids = [fresh(f"{path}{f.name}", f.metadata) for f in t.fields]
        return {"type": "struct", "fields": [
            {"id": i, "name": f.name, "required": not f.nullable, "type": kind(f.dataType, f"{path}{f.name}.", f.metadata or {})} | ({"doc": f.metadata["comment"]} if (f.metadata or {}).get("comment") else {})
            for i, f in zip(ids, t.fields)
        ]}

    def kind(t: T.DataType, path: str, m: dict):
        if isinstance(t, T.StructType):
            return struct(t, path)
        if isinstance(t, T.ArrayType):
            i = fresh(f"{path}{ELEMENT}", None)
            return {"type": "list", "element-id": i, "element-required": not t.containsNull, "element": kind(t.elementType, f"{path}{ELEMENT}.", {})}
        if isinstance(t, T.MapType):
            k, v = fresh(f"{path}{KEY}", None), fresh(f"{path}{VALUE}", None)
            return {"type": "map", "key-id": k, "key": kind(t.keyType, f"{path}{KEY}.", {}), "value-id": v, "value-required": not t.valueContainsNull, "value": kind(t.valueType, f"{path}{VALUE}.", {})}
        if isinstance(t, T.BinaryType) and m.get("kind") in ("uuid", "fixed"):
            return "uuid" if m["kind"] == "uuid" else f"fixed[{m['size']}]"
        if isinstance(t, T.DecimalType):
            return f"decimal({t.precision}, {t.scale})"
        if isinstance(t, (T.ByteType, T.ShortType)):
            return "int"
        for name, cls in _ICEBERG.items():
            if isinstance(t, cls):
                return name
        raise UnsupportedType(t.simpleString())

    out = {"schema-id": schema_id} | struct(schema, "")
    if identifiers:
        paths = dict(iceberg_ids(out))
        missing = [p for p in identifiers if p not in paths]
        if missing:
            raise ValueError(f"record keys {missing} are not in the schema")
        if all(not find(schema, p).nullable for p in identifiers):
            out["identifier-field-ids"] = [paths[p] for p in identifiers]
    return out


def iceberg_ids(schema: dict, path: str = "") -> Iterator[tuple[str, int]]:
    """(path, id) of all fields of an Iceberg schema."""
    for f in schema.get("fields", []):
        yield f"{path}{f['name']}", f["id"]
        yield from _nested_ids(f["type"], f"{path}{f['name']}.")


def _nested_ids(t, path: str) -> Iterator[tuple[str, int]]:
    if isinstance(t, dict):
        if t["type"] == "struct":
            yield from iceberg_ids(t, path)
        for name, key in (("element", ELEMENT), ("key", KEY), ("value", VALUE)):
            if f"{name}-id" in t:
                yield f"{path}{key}", t[f"{name}-id"]
                yield from _nested_ids(t[name], f"{path}{key}.")


def from_iceberg(schema: dict) -> T.StructType:
    def kind(t) -> tuple[T.DataType, dict]:
        if isinstance(t, dict):
            if t["type"] == "struct":
                return from_iceberg(t), {}
            if t["type"] == "list":
                return T.ArrayType(kind(t["element"])[0], not t["element-required"]), {}
            return T.MapType(kind(t["key"])[0], kind(t["value"])[0], not t["value-required"]), {}
        if t == "uuid":
            return T.BinaryType(), {"kind": "uuid", "size": 16}
        if m := re.fullmatch(r"fixed\[(\d+)\]", t):
            return T.BinaryType(), {"kind": "fixed", "size": int(m[1])}
        if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", t):
            return T.DecimalType(int(m[1]), int(m[2])), {}
        if t == "time":
            return T.IntegerType(), {"kind": "time"}
        if t not in _ICEBERG:
            raise UnsupportedType(t)
        return _ICEBERG[t](), {}

    fields = []
    for f in schema["fields"]:
        t, m = kind(f["type"])
        m |= {"field_id": f["id"]} | ({"comment": f["doc"]} if f.get("doc") else {})
        fields.append(T.StructField(f["name"], t, not f["required"], m))
    return T.StructType(fields)


def name_mapping(schema: dict, storage: dict[int, str]) -> list[dict]:
    """Iceberg's name mapping with the files' own names added."""
    def entry(name: str, i: int, t) -> dict:
        out = {"field-id": i, "names": list(dict.fromkeys([name, *([storage[i]] if i in storage else [])]))}
        below = list(below_of(t))
        return out | ({"fields": below} if below else {})

    def below_of(t):
        if isinstance(t, dict):
            if t["type"] == "struct":
                yield from (entry(f["name"], f["id"], f["type"]) for f in t["fields"])
            for n in ("element", "key", "value"):
                if f"{n}-id" in t:
                    yield entry(n, t[f"{n}-id"], t[n])

    return [entry(f["name"], f["id"], f["type"]) for f in schema["fields"]]


# Avro

def to_avro(schema: T.StructType, name: str = "record", namespace: str = "lakeweave") -> dict:
    def record(t: T.StructType, name: str) -> dict:
        fields = []
        for f in t.fields:
            k = kind(f.dataType, f"{name}_{f.name}", f.metadata or {})
            out = {"name": f.name, "type": ["null", k] if f.nullable else k}
            if f.nullable:
                out["default"] = None
            if (f.metadata or {}).get("comment"):
                out["doc"] = f.metadata["comment"]
            if "field_id" in (f.metadata or {}):
                out["field-id"] = f.metadata["field_id"]
            fields.append(out)
        return {"type": "record", "name": name, "fields": fields}

    def kind(t: T.DataType, name: str, m: dict):
        if isinstance(t, T.StructType):
            return record(t, name)
        if isinstance(t, T.ArrayType):
            e = kind(t.elementType, f"{name}_element", {})
            return {"type": "array", "items": ["null", e] if t.containsNull else e}
        if isinstance(t, T.MapType):
            if not isinstance(t.keyType, T.StringType):
                raise UnsupportedType("Avro maps have string keys")
            v = kind(t.valueType, f"{name}_value", {})
            return {"type": "map", "values": ["null", v] if t.valueContainsNull else v}
        if isinstance(t, T.DecimalType):
            logical = {"logicalType": "decimal", "precision": t.precision, "scale": t.scale}
            return ({"type": "fixed", "name": name, "size": m["size"]} if "size" in m else {"type": "bytes"}) | logical
        if isinstance(t, T.BinaryType):
            if m.get("kind") == "uuid":
                return {"type": "fixed", "name": name, "size": 16, "logicalKind": "uuid"}
            return {"type": "fixed", "name": name, "size": m["size"]} if m.get("kind") == "fixed" else "bytes"
        if isinstance(t, T.StringType):
            return {"type": "enum", "name": name, "symbols": m["symbols"]} if m.get("kind") == "enum" else "string"
        unit = "millis" if m.get("precision") == "millis" else "micros"
        simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DateType: {"type": "int", "logicalType": "date"}, T.TimestampType: {"type": "long", "logicalType": f"timestamp-{unit}"}, T.TimestampNTZType: {"type": "long", "logicalType": f"local-timestamp-{unit}"}}
        if type(t) not in simple:
            raise UnsupportedType(t.simpleString())
        return simple[type(t)]

    return record(schema, name) | {"namespace": namespace}


def from_avro(schema: dict) -> T.StructType:
    def nullable(t) -> tuple[object, bool]:
        if isinstance(t, list):
            rest = [x for x in t if x != "null"]
            if len(rest) != 1 or len(t) > 2:
                raise UnsupportedType("only unions of null and one type are read")
            return rest[0], len(rest) < len(t)
        return t, False

    def kind(t) -> tuple[T.DataType, dict]:
        if isinstance(t, str):
            t = {"type": t}
        name, logical = t["type"], t.get("logicalType")
        if isinstance(name, (dict, list)):
            return kind(name)
        if name == "record":
            return from_avro(t), {}
        if name == "array":
            e, n = nullable(t["items"])
            return T.ArrayType(kind(e)[0], n), {}
        if name == "map":
            v, n = nullable(t["values"])
            return T.MapType(T.StringType(), kind(v)[0], n), {}
        if logical == "decimal":
            return T.DecimalType(t["precision"], t.get("scale", 0)), {"size": t["size"]} if "size" in t else {}
        if name == "enum":
            return T.StringType(), {"kind": "enum", "symbols": t["symbols"]}
        if name == "fixed":
            return T.BinaryType(), {"kind": t.get("logicalKind", "fixed"), "size": t["size"]}
        if logical in ("timestamp-millis", "timestamp-micros"):
            return T.TimestampType(), {"precision": logical[10:]}
        if logical in ("local-timestamp-millis", "local-timestamp-micros"):
            return T.TimestampNTZType(), {"precision": logical[16:]}
        if logical == "date":
            return T.DateType(), {}
        simple = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "null": T.NullType()}
        if name not in simple:
            raise UnsupportedType(str(name))
        return simple[name], {}

    fields = []
    for f in schema["fields"]:
        t, n = nullable(f["type"])
        k, m = kind(t)
        m |= ({"comment": f["doc"]} if f.get("doc") else {}) | ({"field_id": f["field-id"]} if "field-id" in f else {})
        fields.append(T.StructField(f["name"], k, n, m))
    return T.StructType(fields)


# Parquet, by way of Arrow

def from_arrow(schema) -> T.StructType:
    import pyarrow as pa
    from pyarrow import types as A

    def kind(t) -> tuple[T.DataType, dict]:
        if A.is_struct(t):
            return T.StructType([field(t.field(k)) for k in range(t.num_fields)]), {}
        if A.is_list(t) or A.is_large_list(t):
            return T.ArrayType(kind(t.value_type)[0], t.value_field.nullable), {}
        if A.is_map(t):
            return T.MapType(kind(t.key_type)[0], kind(t.item_type)[0], t.item_field.nullable), {}
        if A.is_decimal(t):
            return T.DecimalType(t.precision, t.scale), {}
        if A.is_timestamp(t):
            unit = {"ms": "millis", "us": "micros", "ns": "nanos", "s": "millis"}[t.unit]
            return (T.TimestampType() if t.tz else T.TimestampNTZType()), {"precision": unit}
        if A.is_time(t):
            return T.IntegerType() if t.bit_width == 32 else T.LongType(), {"kind": "time"}
        if A.is_fixed_size_binary(t):
            return T.BinaryType(), {"kind": "fixed", "size": t.byte_width}
        for test, out in ((A.is_boolean, T.BooleanType()), (A.is_date, T.DateType()), (A.is_float32, T.FloatType()), (A.is_float64, T.DoubleType()), (A.is_int64, T.LongType()), (A.is_uint32, T.LongType()), (A.is_integer, T.IntegerType()), (A.is_string, T.StringType()), (A.is_large_string, T.StringType()), (A.is_binary, T.BinaryType()), (A.is_large_binary, T.BinaryType()), (A.is_null, T.NullType())):
            if test(t):
                return out, {}
        if A.is_dictionary(t):
            return kind(t.value_type)
        raise UnsupportedType(str(t))

    def field(f: pa.Field) -> T.StructField:
        t, m = kind(f.type)
        i = (f.metadata or {}).get(b"PARQUET:field_id")
        return T.StructField(f.name, t, f.nullable, m | ({"field_id": int(i)} if i and int(i) >= 0 else {}))

    return T.StructType([field(f) for f in schema])


def to_arrow(schema: T.StructType):
    import pyarrow as pa

    def kind(t: T.DataType, m: dict):
        if isinstance(t, T.StructType):
            return pa.struct([field(f) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return pa.list_(pa.field("element", kind(t.elementType, {}), t.containsNull))
        if isinstance(t, T.MapType):
            return pa.map_(kind(t.keyType, {}), pa.field("value", kind(t.valueType, {}), t.valueContainsNull))
        if isinstance(t, T.DecimalType):
            return pa.decimal128(t.precision, t.scale)
        unit = {"millis": "ms", "nanos": "ns"}.get(m.get("precision"), "us")
        if isinstance(t, T.TimestampType):
            return pa.timestamp(unit, "UTC")
        if isinstance(t, T.TimestampNTZType):
            return pa.timestamp(unit)
        if isinstance(t, T.BinaryType):
            return pa.binary(m["size"]) if m.get("kind") in ("uuid", "fixed") else pa.binary()
        simple = {T.BooleanType: pa.bool_(), T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.DateType: pa.date32()}
        if type(t) not in simple:
            raise UnsupportedType(t.simpleString())
        return simple[type(t)]

    def field(f: T.StructField):
        m = f.metadata or {}
        return pa.field(f.name, kind(f.dataType, m), f.nullable, {"PARQUET:field_id": str(m["field_id"])} if "field_id" in m else None)

    return pa.schema([field(f) for f in schema.fields])


# Paimon

def from_paimon(schema: dict) -> T.StructType:
    def kind(t) -> tuple[T.DataType, dict, bool]:
        if isinstance(t, dict):
            name = t["type"].upper()
            n = "NOT NULL" not in name
            if name.startswith("ARRAY"):
                e, _, en = kind(t["element"])
                return T.ArrayType(e, en), {}, n
            if name.startswith("MAP"):
                v, _, vn = kind(t["value"])
                return T.MapType(kind(t["key"])[0], v, vn), {}, n
            return T.StructType([field(f) for f in t["fields"]]), {}, n
        name = t.upper().removesuffix(" NOT NULL").strip()
        n = not t.upper().strip().endswith("NOT NULL")
        base, size = re.match(r"([A-Z_ ]+?)\s*(?:\(([\d, ]+)\))?(?:\s+(?:WITH|WITHOUT).*)?$", name).groups()
        digits = [int(x) for x in (size or "").split(",") if x.strip()]
        if base in ("TINYINT", "SMALLINT", "INT", "INTEGER"):
            return T.IntegerType(), {}, n
        if base in ("CHAR", "VARCHAR", "STRING"):
            return T.StringType(), {}, n
        if base in ("BINARY", "VARBINARY", "BYTES"):
            return T.BinaryType(), {}, n
        if base == "DECIMAL":
            return T.DecimalType(*(digits or [10, 0])), {}, n
        if base.startswith("TIMESTAMP"):
            p = digits[0] if digits else 6
            return T.TimestampType(), {"precision": "millis" if p <= 3 else "micros" if p <= 6 else "nanos"}, n
        simple = {"BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType()}
        if base not in simple:
            raise UnsupportedType(t)
        return simple[base], {}, n

    def field(f: dict) -> T.StructField:
        t, m, n = kind(f["type"])
        return T.StructField(f["name"], t, n, m | {"field_id": f["id"]} | ({"comment": f["description"]} if f.get("description") else {}))

    return T.StructType([field(f) for f in schema["fields"]])


# Catalogs

#: What Hive-style catalogs allow.
COMMENT_CHARS, SCHEMA_PART_CHARS = 255, 4000


def hive_type(t: T.DataType, metadata: dict | None = None) -> str:
    """The type string of Hive-style catalogs."""
    if isinstance(t, T.StructType):
        return "struct<" + ",".join(f"{f.name}:{hive_type(f.dataType, f.metadata)}" for f in t.fields) + ">"
    if isinstance(t, T.ArrayType):
        return f"array<{hive_type(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"map<{hive_type(t.keyType)},{hive_type(t.valueType)}>"
    if (metadata or {}).get("kind") == "uuid" or isinstance(t, T.NullType):
        raise UnsupportedType("Hive-style catalogs have no such type")
    return "timestamp" if isinstance(t, T.TimestampNTZType) else t.simpleString()


def catalog_columns(schema: T.StructType, before: list[dict] | None = None) -> list[dict]:
    """Columns for a catalog, first of each name; dropped ones stay, marked as not current."""
    out: dict[str, dict] = {}
    for f in schema.fields:
        comment = ((f.metadata or {}).get("comment") or "")[:COMMENT_CHARS]
        out.setdefault(f.name, {"name": f.name, "type": hive_type(f.dataType, f.metadata), "comment": comment, "current": True})
    for c in before or []:
        out.setdefault(c["name"], c | {"current": False})
    return list(out.values())


def catalog_columns_merge(columns: list[dict], before: list[dict]) -> list[dict]:
    """``columns``, and those that only ``before`` had, marked as not current."""
    names = {c["name"] for c in columns}
    return columns + [c | {"current": False} for c in before if c["name"] not in names]


def schema_properties(schema: T.StructType, partition_names: list[str]) -> dict[str, str]:
    """Table properties that carry a Spark schema: partition columns last, JSON in parts."""
    ordered = [f for f in schema.fields if f.name not in partition_names] + [f for n in partition_names for f in schema.fields if f.name == n]
    text = T.StructType(ordered).json()
    parts = [text[k : k + SCHEMA_PART_CHARS] for k in range(0, len(text), SCHEMA_PART_CHARS)]
    out = {"spark.sql.sources.schema.numParts": str(len(parts))} | {f"spark.sql.sources.schema.part.{k}": p for k, p in enumerate(parts)}
    out |= {"spark.sql.sources.schema.numPartCols": str(len(partition_names))} if partition_names else {}
    return out | {f"spark.sql.sources.schema.partCol.{k}": n for k, n in enumerate(partition_names)}


# Field ids where the format has none

def track_ids(schema: T.StructType, before: dict[str, int] | None = None, last: int = 0) -> tuple[dict[str, int], int]:
    """Ids by path: kept by name, new ones counted on from ``last``, level by level."""
    before = before or {}
    out: dict[str, int] = {}
    last = max([last, *before.values()])
    level = [(f.name, f) for f in schema.fields]
    while level:
        for path, _ in level:
            if path in before:
                out[path] = before[path]
            else:
                last += 1
                out[path] = last
        level = [(f"{path}.{c.name}", c) for path, f in level for c in children(f.dataType)]
    return out, last


def with_ids(schema: T.StructType, ids: dict[str, int]) -> T.StructType:
    """Top-level and nested struct fields with their ids as metadata."""
    def struct(t: T.StructType, path: str) -> T.StructType:
        return T.StructType([T.StructField(f.name, kind(f.dataType, f"{path}{f.name}."), f.nullable, dict(f.metadata or {}) | ({"field_id": ids[f"{path}{f.name}"], "parquet.field.id": ids[f"{path}{f.name}"]} if f"{path}{f.name}" in ids else {})) for f in t.fields])

    def kind(t: T.DataType, path: str) -> T.DataType:
        if isinstance(t, T.StructType):
            return struct(t, path)
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType, f"{path}{ELEMENT}."), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(kind(t.keyType, f"{path}{KEY}."), kind(t.valueType, f"{path}{VALUE}."), t.valueContainsNull)
        return t

    return struct(schema, "")
