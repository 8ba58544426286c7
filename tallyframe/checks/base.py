"""How a query is registered, and the form in which results are compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
PROJECTS = ("STANDARD", "ECONOMY", "LARGE")
EXCLUDED_PROJECTS = ("SMALL", "MEDIUM")
CATEGORIES = ("1-URGENT", "2-HIGH", "5-LOW")
ACCOUNTS = ("click", "purchase", "signup", "view")
HOME_PREFIX = "M"
TYPE_NAMES = ("Interns", "Other groups", "Home")
MONTH = "2001-07"
RATES_START = "1998-01-01"
EOD_START, EOD_END = "20240101", "20240131"


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None = None


def plain(df: DataFrame) -> DataFrame:
    """Text, long, double and boolean columns only, so engines compare alike."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.substring(value.cast("string"), 1, 19)
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            value = value.cast("bigint")
        columns.append(value.alias(field.name))
    return df.select(*columns)
