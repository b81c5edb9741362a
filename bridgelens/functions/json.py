"""Path access into the semi-structured ``data`` column.

The column is parsed to VARIANT once per row (``with_variant``); every path is
then read from the parsed value.  A saved VARIANT column is used as is, which
lets the Parquet reader fetch only the requested paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType


def with_variant(df: DataFrame, column: str = "data") -> DataFrame:
    """Return ``df`` with ``column`` as VARIANT (malformed JSON -> NULL)."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, VariantType):
        return df
    if isinstance(dtype, StringType):
        return df.withColumn(column, F.try_parse_json(F.col(column)))
    raise TypeError(f"column {column!r} must be STRING (JSON text) or VARIANT, got {dtype}")


def json_text(v: Column | str, path: str) -> Column:
    """Value at ``path`` rendered as text, like a ``::STRING`` cast.

    Strings come back unquoted, numbers and booleans as their literal,
    arrays and objects as compact JSON; JSON null and a missing path are NULL.
    """
    return F.try_variant_get(v, path, "string")


def json_kind(v: Column | str, path: str) -> Column:
    """Kind of the value at ``path``: 'array', 'object', 'null' or 'scalar'.

    A missing path (or unparsable document) gives SQL NULL.
    """
    sub = F.try_variant_get(v, path, "variant")
    schema = F.schema_of_variant(sub)
    return (
        F.when(sub.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(sub), F.lit("null"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("scalar"))
    )
