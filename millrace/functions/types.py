"""Which types hold every value of which others."""

from __future__ import annotations

from pyspark.sql import types as T

#: Whole types with the digits they may need; doubles hold integers of 32 bits and floats exactly.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def fits(kind: T.DataType, into: T.DataType) -> bool:
    """Whether each value of a type is one of another, unchanged."""
    if isinstance(kind, T.NullType) or kind == into:
        return True
    if isinstance(kind, T.StringType) and isinstance(into, T.StringType):
        return True
    digits = _WHOLE.get(type(kind))
    if digits and type(into) in _WHOLE:
        return digits <= _WHOLE[type(into)]
    if digits and isinstance(into, T.DecimalType):
        return digits <= into.precision - into.scale
    if isinstance(kind, T.DecimalType) and isinstance(into, T.DecimalType):
        return kind.scale <= into.scale and kind.precision - kind.scale <= into.precision - into.scale
    if isinstance(into, T.DoubleType):
        return isinstance(kind, T.FloatType) or (digits or 99) <= 10
    if isinstance(kind, T.ArrayType) and isinstance(into, T.ArrayType):
        return fits(kind.elementType, into.elementType)
    if isinstance(kind, T.MapType) and isinstance(into, T.MapType):
        return fits(kind.keyType, into.keyType) and fits(kind.valueType, into.valueType)
    if isinstance(kind, T.StructType) and isinstance(into, T.StructType):
        return kind.names == into.names and all(fits(a.dataType, b.dataType) for a, b in zip(kind, into))
    return False


def widest(one: T.DataType, other: T.DataType) -> T.DataType | None:
    """That of two types which holds the other, or None. Parquet files of the one can be read as the other."""
    return one if fits(other, one) else other if fits(one, other) else None
