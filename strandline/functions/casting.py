"""Types: decimals to doubles, and text to declared types with missing tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens the pandas CSV reader takes for a missing value by default.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def doubles_for_decimals(dtype: T.DataType) -> T.DataType:
    """``dtype`` with every decimal in it, nested ones too, replaced by double."""
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(doubles_for_decimals(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(
            doubles_for_decimals(dtype.keyType), doubles_for_decimals(dtype.valueType), dtype.valueContainsNull
        )
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(f.name, doubles_for_decimals(f.dataType), f.nullable, f.metadata) for f in dtype]
        )
    return dtype


def decimal_to_double(df: DataFrame) -> DataFrame:
    """Cast every decimal in the frame to double; other columns and the order stay."""

    def convert(field: T.StructField) -> Column:
        column = df[f"`{field.name}`"]
        target = doubles_for_decimals(field.dataType)
        return column if target == field.dataType else column.cast(target).alias(field.name)

    return df.select(*map(convert, df.schema))


def parse_text(
    text: Column, dtype: T.DataType, strict: bool = False, missing: tuple[str, ...] = MISSING_TOKENS
) -> Column:
    """Text of a landing file to its declared type.

    Tokens for a missing value become NULL. A value that does not fit the type becomes NULL as well, or fails the
    job if ``strict``.
    """
    value = F.when(~text.isin(*missing), text) if missing else text
    if isinstance(dtype, T.StringType):
        return value
    return value.cast(dtype) if strict else value.try_cast(dtype)
