"""Element types of collections and tables, as Spark types, and their translation to and from Avro schemas."""

from __future__ import annotations

import dataclasses
import types as _types
import typing

from pyspark.sql import types as T


def strings() -> T.DataType:
    return T.StringType()


def integers() -> T.DataType:
    return T.IntegerType()


def longs() -> T.DataType:
    return T.LongType()


def floats() -> T.DataType:
    return T.FloatType()


def doubles() -> T.DataType:
    return T.DoubleType()


def booleans() -> T.DataType:
    return T.BooleanType()


def byte_strings() -> T.DataType:
    return T.BinaryType()


def pairs_of(key: T.DataType, value: T.DataType) -> T.StructType:
    """A nested pair: ``struct<key, value>`` with value equality."""
    return T.StructType([T.StructField("key", key), T.StructField("value", value)])


def lists_of(element: T.DataType) -> T.ArrayType:
    """A nested collection."""
    return T.ArrayType(element)


def collection_of(element: T.DataType) -> T.StructType:
    """Schema of a collection of ``element``."""
    return T.StructType([T.StructField("value", element)])


def table_of(key: T.DataType, value: T.DataType) -> T.StructType:
    """Schema of a table from ``key`` to ``value``."""
    return pairs_of(key, value)


_OF_PYTHON = {
    str: T.StringType(),
    int: T.LongType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    bytes: T.BinaryType(),
}


def _of_hint(hint: object) -> T.DataType:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, _types.UnionType):
        (hint,) = [a for a in args if a is not type(None)]
        return _of_hint(hint)
    if origin is list:
        return T.ArrayType(_of_hint(args[0]))
    if origin is dict:
        return T.MapType(_of_hint(args[0]), _of_hint(args[1]))
    if isinstance(hint, T.DataType):
        return hint
    if dataclasses.is_dataclass(hint):
        return records_of(hint)
    return _OF_PYTHON[hint]


def records_of(kind: object) -> T.StructType:
    """Type of records: from a dataclass, an Avro record schema (dict) or a Spark struct."""
    if isinstance(kind, T.StructType):
        return kind
    if isinstance(kind, dict):
        return from_avro(kind)
    hints = typing.get_type_hints(kind)
    return T.StructType([T.StructField(f.name, _of_hint(hints[f.name])) for f in dataclasses.fields(kind)])


#: fixed values: names of the primitive types of Avro
_PRIMITIVE = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
}


#: fixed values: logical types of Avro
_LOGICAL = {
    ("int", "date"): T.DateType(),
    ("long", "timestamp-micros"): T.TimestampType(),
    ("long", "timestamp-millis"): T.TimestampType(),
    ("long", "local-timestamp-micros"): T.TimestampNTZType(),
    ("long", "local-timestamp-millis"): T.TimestampNTZType(),
}


def to_avro(kind: T.DataType, nullable: bool = True, name: str = "Row") -> object:
    """The Avro schema of a Spark type. Nullable types become unions with null."""
    schema: object
    if isinstance(kind, T.StructType):
        fields = [
            {"name": f.name, "type": to_avro(f.dataType, f.nullable, f"{name}_{f.name}"), **({"default": None} if f.nullable else {})}
            for f in kind.fields
        ]
        schema = {"type": "record", "name": name, "fields": fields}
    elif isinstance(kind, T.ArrayType):
        schema = {"type": "array", "items": to_avro(kind.elementType, kind.containsNull, f"{name}_item")}
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        schema = {"type": "map", "values": to_avro(kind.valueType, kind.valueContainsNull, f"{name}_value")}
    elif isinstance(kind, T.DecimalType):
        schema = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, (T.ByteType, T.ShortType)):
        schema = "int"
    else:
        for text, primitive in _PRIMITIVE.items():
            if primitive == kind:
                schema = text
                break
        else:
            for (base, logical), spark_type in _LOGICAL.items():
                if spark_type == kind:
                    schema = {"type": base, "logicalType": logical}
                    break
            else:
                raise TypeError(f"no Avro type for {kind.simpleString()}")
    return ["null", schema] if nullable else schema


def linked(schema: object, names: dict | None = None, space: str = "") -> object:
    """An Avro schema in which references to named types are the types themselves."""
    names = {} if names is None else names
    if isinstance(schema, list):
        return [linked(s, names, space) for s in schema]
    if isinstance(schema, str):
        if schema in _PRIMITIVE or schema == "null":
            return schema
        for full in (f"{space}.{schema}", schema):
            if full in names:
                return names[full]
        raise TypeError(f"unknown Avro type {schema}")
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return linked(kind, names, space)
    if kind in ("record", "error", "enum", "fixed"):
        space = schema.get("namespace", schema["name"].rpartition(".")[0] or space)
        name = schema["name"].rpartition(".")[2]
        out = names[f"{space}.{name}" if space else name] = dict(schema)
        if kind in ("record", "error"):
            out["type"] = "record"
            out["fields"] = [{**f, "type": linked(f["type"], names, space)} for f in schema["fields"]]
        return out
    if kind == "array":
        return {**schema, "items": linked(schema["items"], names, space)}
    if kind == "map":
        return {**schema, "values": linked(schema["values"], names, space)}
    return schema if kind in _PRIMITIVE or kind == "null" else linked(kind, names, space)


def members(union: list) -> list:
    """The types of a union besides null; numbers of several widths count as the widest."""
    rest = [s for s in union if s != "null"]
    for wide, narrow in (("long", "int"), ("double", "float")):
        if len(rest) == 2 and set(map(str, rest)) == {wide, narrow}:
            return [wide]
    return rest


def from_avro(schema: object) -> T.DataType:
    """The Spark type of an Avro schema. A union of several types becomes a struct of member0, member1 …, one of them set."""
    return _from_linked(linked(schema), ())


def _from_linked(schema: object, above: tuple) -> T.DataType:
    if isinstance(schema, list):
        rest = members(schema)
        if not rest:
            raise TypeError("a union of null alone")
        if len(rest) == 1:
            return _from_linked(rest[0], above)
        return T.StructType([T.StructField(f"member{i}", _from_linked(r, above)) for i, r in enumerate(rest)])
    if isinstance(schema, str):
        if schema not in _PRIMITIVE:
            raise TypeError(f"no Spark type for Avro's {schema}")
        return _PRIMITIVE[schema]
    kind = schema["type"]
    logical = schema.get("logicalType")
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if (kind, logical) in _LOGICAL:
        return _LOGICAL[kind, logical]
    if any(schema is s for s in above):
        raise TypeError(f"{schema['name']} contains itself")
    if kind == "record":
        return T.StructType(
            [
                T.StructField(f["name"], _from_linked(f["type"], (*above, schema)), isinstance(f["type"], list) and "null" in f["type"])
                for f in schema["fields"]
            ]
        )
    if kind == "array":
        return T.ArrayType(_from_linked(schema["items"], above))
    if kind == "map":
        return T.MapType(T.StringType(), _from_linked(schema["values"], above))
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    return _PRIMITIVE[kind]


def checked(df, schema: T.StructType | T.DataType | None):
    """``df`` itself, if its columns have the declared types (nullability aside); otherwise an error."""
    if schema is None:
        return df
    if not isinstance(schema, T.StructType):
        schema = collection_of(schema)
    declared = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if declared != df.dtypes:
        raise TypeError(f"declared {declared}, but the columns are {df.dtypes}")
    return df
