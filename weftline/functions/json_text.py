"""JSON text read strictly: keys in the document's order, the last of repeated keys, nothing after the value; NaN and Infinity are numbers.

The JVM's variants sort keys, refuse repeated ones and stop at the end of the first value, so these functions read in
Python workers, in Arrow batches.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StringType, StructField, StructType

#: Whole numbers from here on are kept exactly beside their double.
EXACT = 1 << 53
_VALUE = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("str", pa.string()), ("whole", pa.decimal128(38, 0)), ("form", pa.string())])
_CANONICAL = StructType([StructField("kind", StringType()), StructField("num", DoubleType()), StructField("str", StringType()), StructField("whole", DecimalType(38, 0)), StructField("form", StringType())])


def _texts(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, StringType()) for n in names]))


def read(text: str | None):
    """The value of a JSON text, and whether it is one."""
    try:
        return (None, False) if text is None else (json.loads(text), True)
    except (ValueError, RecursionError):
        return None, False


def written(value) -> str:
    """Minified JSON in the order of the value's keys."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical(value) -> tuple[str, float | None, str | None, Decimal | None, str | None]:
    """kind, num, str, whole and form of a value; see functions.values. Objects and lists are compared by their text with sorted keys."""
    if value is None:
        return "null", None, None, None, None
    if isinstance(value, bool):
        return "num", float(value), None, None, "bool"
    if isinstance(value, int):
        near = float(value) if abs(value) < 10**308 else math.copysign(math.inf, value)
        return "num", near, None, Decimal(value) if EXACT <= abs(value) < 10**38 else None, "int"
    if isinstance(value, float):
        large = EXACT <= abs(value) < 1e38 and value == int(value)
        return "num", value, None, Decimal(int(value)) if large else None, None
    if isinstance(value, str):
        return "str", None, value, None, None
    return "json", None, json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True), None, None


def _lists(rows: list[list | None], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
    """A list array of structs from rows of tuples, built by columns."""
    offsets, at = [], 0
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or ())
    flat = [x for r in rows if r for x in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(kinds)
    fields = [pa.array(c, t) if not pa.types.is_struct(t) else pa.StructArray.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*c, strict=True) if c else [()] * t.num_fields, t, strict=True)], fields=list(t)) for c, (_, t) in zip(columns, kinds, strict=True)]
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds]))


@F.arrow_udf(StringType())
def json_shape(c: pa.Array) -> pa.Array:
    """object, array or other; null for what is no JSON."""
    name = lambda v, ok: ("object" if isinstance(v, dict) else "array" if isinstance(v, list) else "other") if ok else None
    return pa.array([name(*read(x)) for x in c.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", _CANONICAL)])))
def object_entries(c: pa.Array) -> pa.Array:
    """Key and canonical value of every key of a JSON object, in its order; null for anything else."""
    rows = [[(k, canonical(x)) for k, x in v.items()] if isinstance(v, dict) else None for v, _ in map(read, c.to_pylist())]
    return _lists(rows, [("key", pa.string()), ("value", _VALUE)])


@F.arrow_udf(_texts("key", "json"))
def object_items(c: pa.Array) -> pa.Array:
    """Key and minified JSON of every key of a JSON object, in its order; null for anything else."""
    rows = [[(k, written(x)) for k, x in v.items()] if isinstance(v, dict) else None for v, _ in map(read, c.to_pylist())]
    return _lists(rows, [("key", pa.string()), ("json", pa.string())])


@F.arrow_udf(ArrayType(StringType()))
def list_items(c: pa.Array) -> pa.Array:
    """Minified JSON of the items of a JSON list; null for anything else."""
    return pa.array([[written(x) for x in v] if isinstance(v, list) else None for v, _ in map(read, c.to_pylist())], pa.list_(pa.string()))


def _entries(v, suffix: str) -> list[tuple] | None:
    """key, type, name, schema and value of an interface's entries; see content_entries()."""
    if not isinstance(v, dict):
        return None
    text = lambda x: x if x is None or isinstance(x, str) else written(x)
    lists = [(None, v["contents"])] if isinstance(v.get("contents"), list) else [(k, x) for k, x in v.items() if k.endswith(suffix) and isinstance(x, list)]
    kind = lambda x: x["@type"] if x.get("@type") is not None else x.get("type")
    return [(k, text(kind(x)), text(x.get("name")), text(x.get("schema")), text(x.get("value"))) for k, items in lists for x in items if isinstance(x, dict)]


@F.arrow_udf(ArrayType(StructType([StructField("subsystem", StringType()), StructField("names", ArrayType(StringType()))])))
def property_names(c: pa.Array, suffix: pa.Array) -> pa.Array:
    """Of an interface without a contents list, each key that ends in suffix, without it, and the distinct names of its Property entries, in the document's order."""
    rows = []
    for (v, _), end in zip(map(read, c.to_pylist()), suffix.to_pylist(), strict=True):
        found: dict[str, dict[str, None]] = {}
        for key, kind, name, *_ in _entries(v, end) or ():
            if key is not None and kind == "Property" and name is not None:
                found.setdefault(key.removesuffix(end), {})[name] = None
        rows.append([(k, list(names)) for k, names in found.items()] if isinstance(v, dict) else None)
    return _lists(rows, [("subsystem", pa.string()), ("names", pa.list_(pa.string()))])


@F.arrow_udf(_texts("key", "type", "name", "schema", "value"))
def content_entries(c: pa.Array, suffix: pa.Array) -> pa.Array:
    """Entries of an interface: of its contents list (key null), else of the lists of all keys that end in suffix, in the document's order. Items that are no object are left out."""

    rows = [_entries(v, end) for (v, _), end in zip(map(read, c.to_pylist()), suffix.to_pylist(), strict=True)]
    return _lists(rows, [(n, pa.string()) for n in ("key", "type", "name", "schema", "value")])


def is_object(c: Column) -> Column:
    return F.coalesce(json_shape(c) == "object", F.lit(False))


def is_array(c: Column) -> Column:
    return F.coalesce(json_shape(c) == "array", F.lit(False))
