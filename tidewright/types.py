"""Names of types across systems, and schema fingerprints."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import types as T

#: substring -> type, first match wins; a decimal counts as float
_RULES = (
    (("int", "serial"), "int"), (("float", "double", "real", "numeric", "decimal"), "float"), (("bool",), "bool"), (("datetime", "timestamp"), "datetime"),
)
_TEXT = ("char", "text", "string", "str", "utf8", "uuid", "enum", "categorical")


def normalize_dtype(name: str) -> str:
    """One of int, float, bool, datetime, date, string, other, by what a type's name contains."""
    low = name.strip().lower()
    for parts, kind in _RULES:
        if any(p in low for p in parts):
            return kind
    if low == "date":
        return "date"
    return "string" if any(p in low for p in _TEXT) else "other"


def kind_of(t: T.DataType) -> str:
    return normalize_dtype(t.simpleString()) if not isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else "other"


def snake_case(name: str) -> str:
    """kebab-case, camelCase and words as snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[-\s.]+", "_", name.strip()).lower()


def normalize_keys(x):
    """A nested configuration with all its keys in snake case."""
    if isinstance(x, dict):
        return {snake_case(str(k)): normalize_keys(v) for k, v in x.items()}
    return [normalize_keys(v) for v in x] if isinstance(x, list) else x


def fingerprint(tables: dict[str, T.StructType]) -> str:
    """SHA-256 over sorted tables and their name:type:nullable."""
    lines = [f"{t}|" + ",".join(f"{f.name}:{kind_of(f.dataType)}:{f.nullable}" for f in s.fields) for t, s in sorted(tables.items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
