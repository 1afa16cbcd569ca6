"""Column statistics as rows and as values: ranges of files, their collapse, and the spellings of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the scale that index records keep decimals in.
INDEX_SCALE = 15
#: The wrapper that an index record puts a value in, by type.
WRAPPERS = {
    "boolean": "BooleanWrapper", "int": "IntWrapper", "bigint": "LongWrapper", "float": "FloatWrapper", "double": "DoubleWrapper",
    "string": "StringWrapper", "binary": "BytesWrapper", "date": "DateWrapper", "timestamp": "TimestampMicrosWrapper",
    "timestamp_ntz": "TimestampMicrosWrapper", "decimal": "DecimalWrapper",
}


def leaves(schema: T.StructType, path: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of the scalar columns; lists and maps have no range."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{path}{f.name}.")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append((f"{path}{f.name}", f.dataType))
    return out


def ranges(files: DataFrame, schema: T.StructType) -> DataFrame:
    """path, column, low, high (text), nulls, rows: a row for each file and scalar column that its statistics bound."""
    at = lambda side, name: F.get_json_object("stats", "$." + side + "".join(f"['{x}']" for x in name.split(".")))
    cells = [F.struct(F.lit(name).alias("column"), at("minValues", name).alias("low"), at("maxValues", name).alias("high"), at("nullCount", name).cast("long").alias("nulls")) for name, _ in leaves(schema)]
    rows = F.get_json_object("stats", "$.numRecords").cast("long").alias("rows")
    return files.select("path", rows, F.explode(F.array(*cells)).alias("c")).select("path", "c.*", "rows").filter("low IS NOT NULL OR high IS NOT NULL OR nulls IS NOT NULL")


def collapsed(low: Column, high: Column) -> Column:
    """A range of one value is that value: struct<low, high, scalar>."""
    return F.struct(low.alias("low"), high.alias("high"), low.eqNullSafe(high).alias("scalar"))


def exact_decimal(value: Column, precision: int, scale: int) -> Column:
    """A decimal in another scale; digits that would be lost are an error."""
    out = value.cast(f"decimal({precision},{scale})")
    return F.when(value.isNull() | (out == value), out).otherwise(F.raise_error(F.concat(F.lit("a decimal would lose digits: "), value.cast("string"))))


def to_log(value: Column, kind: T.DataType) -> Column:
    """A bound as text, as the log of a Delta table spells it: dates as ISO, times as UTC seconds and their fraction."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return value.cast("string")


def from_log(text: Column, kind: T.DataType) -> Column:
    """The bound that a log's text means; doubles may be NaN or infinite, decimals keep all digits."""
    if isinstance(kind, T.DecimalType):
        return exact_decimal(text.cast("decimal(38,18)"), kind.precision, kind.scale)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.when(text == "NaN", F.lit(float("nan"))).when(text == "Infinity", F.lit(float("inf"))).when(text == "-Infinity", F.lit(float("-inf")))
        return F.coalesce(odd, text.try_cast("double")).cast(kind)
    return text.try_cast(kind)


def to_index(value: Column, kind: T.DataType) -> Column:
    """A bound as an index record holds it: struct<wrapper, value>; dates are days, times microseconds, decimals scaled."""
    if isinstance(kind, T.DecimalType):
        return F.struct(F.lit(WRAPPERS["decimal"]).alias("wrapper"), value.cast(f"decimal(38,{INDEX_SCALE})").cast("string").alias("value"))
    if isinstance(kind, T.DateType):
        text = F.unix_date(value).cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(value.cast("timestamp")).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.base64(value)
    else:
        text = value.cast("string")
    return F.struct(F.lit(WRAPPERS[kind.simpleString()]).alias("wrapper"), text.alias("value"))


def from_index(wrapped: Column, kind: T.DataType) -> Column:
    """The bound in an index record, in its column's type."""
    text = wrapped["value"]
    if isinstance(kind, T.DecimalType):
        return exact_decimal(text.cast(f"decimal(38,{INDEX_SCALE})"), kind.precision, kind.scale)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(text.cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(text.cast("long")).cast(kind)
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)
