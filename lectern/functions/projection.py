"""Projections that walk a table's schema to any depth.

``without`` drops every field of the given names, in structs, in elements of arrays and in keys and values of maps.
Defined results: null structs, arrays and maps stay null; names are compared exactly; a struct all of whose fields go
becomes a boolean of the same name that says whether it was there; a top column of a dropped name goes as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has(kind: T.DataType, names: frozenset[str]) -> bool:
    """Whether a type has a field of these names anywhere."""
    if isinstance(kind, T.StructType):
        return any(f.name in names or has(f.dataType, names) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has(kind.elementType, names)
    return isinstance(kind, T.MapType) and (has(kind.keyType, names) or has(kind.valueType, names))


def _cleaned(value: Column, kind: T.DataType, names: frozenset[str]) -> Column:
    if not has(kind, names):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _cleaned(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_cleaned(e["key"], kind.keyType, names).alias("key"), _cleaned(e["value"], kind.valueType, names).alias("value"))
        return F.map_from_entries(F.transform(F.map_entries(value), entry))
    kept = [f for f in kind.fields if f.name not in names]
    if not kept:
        return value.isNotNull()
    return F.when(value.isNotNull(), F.struct(*[_cleaned(value.getField(f.name), f.dataType, names).alias(f.name) for f in kept]))


def without(rows: DataFrame, *names: str) -> DataFrame:
    gone = frozenset(names)
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return rows.select(*[_cleaned(quoted(f.name), f.dataType, gone).alias(f.name) for f in rows.schema.fields if f.name not in gone])
