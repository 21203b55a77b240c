"""Logical types of declarations: synonyms, Spark types, and when two types are the same."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# fixed values: type names that mean the same
SYNONYMS = {
    "INT": "INTEGER", "INT4": "INTEGER", "SIGNED": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT", "INT2": "SMALLINT", "SHORT": "SMALLINT", "INT1": "TINYINT",
    "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR", "BPCHAR": "VARCHAR", "NUMERIC": "DECIMAL", "DEC": "DECIMAL", "FLOAT8": "DOUBLE", "REAL": "FLOAT", "FLOAT4": "FLOAT",
    "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN", "DATETIME": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE", "BYTEA": "BLOB", "BINARY": "BLOB", "VARBINARY": "BLOB",
}
PLAIN = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "HUGEINT": T.DecimalType(38, 0),
    "UTINYINT": T.ShortType(), "USMALLINT": T.IntegerType(), "UINTEGER": T.LongType(), "UBIGINT": T.DecimalType(20, 0), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "TIME": T.LongType(), "BLOB": T.BinaryType(), "UUID": T.StringType(), "JSON": T.StringType(),
}


def normalize(name: str, aliases: dict[str, str] | None = None) -> str:
    """A type name without synonyms; a bare DECIMAL is DECIMAL(18,3); lists keep their []."""
    text = re.sub(r"\s+", " ", name.strip())
    if text.endswith("[]"):
        return normalize(text[:-2], aliases) + "[]"
    if aliases and text.lower() in {k.lower() for k in aliases}:
        return normalize(next(v for k, v in aliases.items() if k.lower() == text.lower()), None)
    m = re.fullmatch(r"([A-Za-z_0-9 ]+?)\s*(?:\(\s*([\d\s,]+)\))?", text)
    if not m:
        raise ValueError(f"not a type: {name}")
    base, args = m[1].upper(), m[2]
    base = SYNONYMS.get(base, base)
    if base == "DECIMAL":
        parts = [int(x) for x in args.split(",")] if args else [18, 3]
        return f"DECIMAL({parts[0]},{parts[1] if len(parts) > 1 else 0})"
    if base == "VARCHAR":
        return f"VARCHAR({int(args)})" if args else "VARCHAR"
    if base not in PLAIN:
        raise ValueError(f"unknown type: {name}")
    return base


def to_spark(name: str, aliases: dict[str, str] | None = None) -> T.DataType:
    text = normalize(name, aliases)
    if text.endswith("[]"):
        return T.ArrayType(to_spark(text[:-2]))
    if text.startswith("VARCHAR"):
        return T.StringType()
    if text.startswith("DECIMAL"):
        p, s = map(int, text[8:-1].split(","))
        return T.DecimalType(p, s)
    return PLAIN[text]


def from_spark(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "VARCHAR"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return from_spark(kind.elementType) + "[]"
    for name in ("BOOLEAN", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "DOUBLE", "FLOAT", "DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "BLOB"):
        if kind == PLAIN[name]:
            return name
    return kind.simpleString().upper()


def same(declared: str, resolved: str) -> bool:
    """Synonyms are equal; a resolved VARCHAR without a length fits any; an untyped NULL fits everything."""
    if resolved.upper() in ("VOID", "NULL", '"NULL"'):
        return True
    a, b = normalize(declared), normalize(resolved)
    return a == b or (a.startswith("VARCHAR") and b == "VARCHAR")
