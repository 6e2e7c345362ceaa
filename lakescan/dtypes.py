"""Types: Arrow to Spark, names, predicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_NAMES = {
    T.BooleanType: "bool",
    T.ByteType: "i8",
    T.ShortType: "i16",
    T.IntegerType: "i32",
    T.LongType: "i64",
    T.FloatType: "f32",
    T.DoubleType: "f64",
    T.StringType: "string",
    T.BinaryType: "binary",
    T.DateType: "date",
    T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp_ntz",
    T.NullType: "null",
}
_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def display(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"list[{display(t.elementType)}]"
    if isinstance(t, T.MapType):
        return f"map<{display(t.keyType)}, {display(t.valueType)}>"
    if isinstance(t, T.StructType):
        return f"struct<{', '.join(f'{f.name}: {display(f.dataType)}' for f in t.fields)}>"
    return _NAMES.get(type(t), t.simpleString())


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_binary(t: T.DataType) -> bool:
    return isinstance(t, T.BinaryType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DatetimeType, T.AnyTimeType if hasattr(T, "AnyTimeType") else T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType))


def is_primitive(t: T.DataType) -> bool:
    return isinstance(t, (T.BooleanType, *INTEGERS, T.FloatType, T.DoubleType, T.DateType))


def is_vectorised(t: T.DataType) -> bool:
    """Fixed width and not a bit."""
    return is_primitive(t) and not isinstance(t, T.BooleanType)


def byte_size(t: T.DataType) -> int | None:
    return _WIDTHS.get(type(t))


def accepted(t: pa.DataType) -> pa.DataType:
    """The nearest Arrow type that Spark takes; unsigned integers widen."""
    table = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.date64(): pa.date32(), pa.string_view(): pa.string(), pa.binary_view(): pa.binary()}
    if t in table:
        return table[t]
    if pa.types.is_dictionary(t):
        return accepted(t.value_type)
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pa.types.is_duration(t):
        return pa.duration("us")
    if pa.types.is_time(t):
        return pa.time64("us")
    if pa.types.is_fixed_size_list(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(accepted(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, accepted(f.type), True) for f in t])
    if pa.types.is_map(t):
        return pa.map_(accepted(t.key_type), accepted(t.item_type))
    return t


def accepted_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, accepted(f.type), True) for f in schema])


def accepted_table(data: pa.Table) -> pa.Table:
    return pa.table([_cast(c, accepted(c.type)) for c in data.columns], schema=accepted_schema(data.schema))


def _cast(column: pa.ChunkedArray, t: pa.DataType) -> pa.ChunkedArray:
    if column.type == t:
        return column
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    return column.cast(t, safe=False)
