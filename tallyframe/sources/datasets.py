"""The export files of the datasets, and how each becomes a typed frame.

One row of configuration per dataset: header names, preamble lines, separator,
date patterns. `read_export` turns files into the dataset's schema; unreadable
values become null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.dates import to_timestamp
from tallyframe.functions.labels import flag, two_way
from tallyframe.schemas import DATASETS
from tallyframe.sources.exports import read_after_preamble, read_by_header, union_exports
from tallyframe.sources.tables import stored


@dataclass(frozen=True)
class Export:
    """File layout of a dataset: header name to column name, and how to read it."""

    dataset: str
    columns: Mapping[str, str]
    skip: int = 0
    sep: str = ","
    date_formats: Mapping[str, str] = field(default_factory=dict)
    flag_mark: str = "X"

    @property
    def schema(self) -> T.StructType:
        return DATASETS[self.dataset]


# Header names, preamble lines, separators and date patterns of
# the export files.
EXPORTS = {
    "usage": Export(
        "usage",
        {
            "Category": "category",
            "Subscription": "subscription",
            "Cost": "cost",
            "UsageDate": "usage_date",
            "Resource Group": "resource_group",
        },
        skip=2,
        date_formats={"usage_date": "yyyy-MM-dd HH:mm:ss"},
    ),
    "sponsor": Export(
        "sponsor",
        {
            "Date": "date",
            "ServiceName": "service_name",
            "ServiceType": "service_type",
            "ServiceRegion": "service_region",
            "ServiceResource": "service_resource",
            "Cost": "cost",
        },
    ),
    "rates": Export(
        "rates",
        {
            "Employee": "employee",
            "Project": "project",
            "InitRate": "init_rate",
            "FTE": "fte",
            "Period": "period",
            "Rank": "rank",
            "Level": "level",
            "Target2": "target",
            "Billed": "billed",
            "ind_eligibility": "indiv_eligibility",
        },
        skip=1,
    ),
    "holiday": Export(
        "holiday",
        {"Date": "holiday", "Holiday": "holiday_name"},
        date_formats={"holiday": "yyyy-MM-dd"},
    ),
    "invoice": Export(
        "invoice",
        {
            "CLIENT": "client",
            "INV_DATE": "inv_date",
            "DUE_DATE": "due_date",
            "INV_AMOUNT": "inv_amount",
            "DATE_PAID": "date_paid",
            "PAYMENT_AMOUNT": "payment_amount",
            "TX_TYPE": "tx_type",
        },
        sep="|",
    ),
    "employee": Export(
        "employee",
        {
            "Employee": "employee",
            "GRP": "grp",
            "Resigned": "resigned",
            "LastDay": "last_day",
            "Rank": "rank",
            "Level": "level",
            "Start": "start",
            "Account": "account",
            "GRP2": "grp2",
            "Company": "company",
            "Include": "include",
            "Remarks": "remarks",
            "BilledProj": "billed_project",
            "Activities": "activities",
        },
    ),
    "eod": Export(
        "eod",
        {
            "EmployeeName": "employee_name",
            "Date": "date",
            "Account": "account",
            "Hours": "hours",
            "Minutes": "minutes",
        },
    ),
}


FILE = "_file"


def _as_text(
    spark: SparkSession,
    export: Export,
    path: str | list[str],
    name_pattern: str | None,
    multiline: bool,
) -> DataFrame:
    """The dataset's columns as text, and the file of each row; columns the files lack are null."""
    if export.skip:
        raw = read_after_preamble(
            spark, path, export.skip, list(export.columns), export.sep, name_pattern, multiline, FILE
        )
    else:
        raw = read_by_header(spark, path, export.sep, name_pattern, multiline, file=FILE)
    # All at once: a new name may equal another column's old one.
    held = set(raw.columns)
    named = [
        (F.col(f"`{old}`") if old in held else F.lit(None).cast("string")).alias(new)
        for old, new in export.columns.items()
    ]
    return raw.select(FILE, *named)


def read_export(
    spark: SparkSession,
    export: Export,
    path: str | list[str],
    name_pattern: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """The export files under a path as the dataset's schema.

    Columns are found by header name; other columns of the file are ignored and
    dataset columns the files lack are null.
    """
    named = _as_text(spark, export, path, name_pattern, multiline)
    return named.select(*[_typed(named, export, column) for column in export.schema])


@dataclass(frozen=True)
class Checked:
    """Rows in the dataset's schema; every unreadable value with its file, column and text; their counts."""

    rows: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def read_checked(
    spark: SparkSession,
    export: Export,
    path: str | list[str],
    name_pattern: str | None = None,
    multiline: bool = False,
) -> Checked:
    """`read_export`, with the values that are present and not readable set aside.

    The records are parsed once and stored with their unreadable values; the counts
    are observed while that table is written, and rows and quarantine are read from it.
    """
    named = _as_text(spark, export, path, name_pattern, multiline)
    kinds = [c for c in export.schema if c.name in named.columns and not isinstance(c.dataType, T.BooleanType)]
    bad = [
        F.when(
            (F.trim(c.name) != "") & _typed(named, export, c).isNull(),
            F.struct(F.lit(c.name).alias("column"), F.col(c.name).alias("raw")),
        )
        for c in kinds
    ]
    values = [_typed(named, export, column) for column in export.schema]
    marked = named.select(FILE, *values, F.filter(F.array(*bad), lambda b: b.isNotNull()).alias("_bad"))
    seen = Observation()
    holds = lambda name: F.exists("_bad", lambda b: b["column"] == name)
    table = stored(marked.observe(seen, *[F.count_if(holds(c.name)).alias(c.name) for c in kinds]))
    quarantine = table.select(F.col(FILE).alias("file"), F.inline("_bad"))
    return Checked(table.select(export.schema.names), quarantine, seen.get)


def rejected(
    spark: SparkSession,
    export: Export,
    path: str | list[str],
    name_pattern: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """One row: per column, how many values are present in the files but not readable as its type."""
    named = _as_text(spark, export, path, name_pattern, multiline)
    kinds = [c for c in export.schema if c.name in named.columns and not isinstance(c.dataType, T.BooleanType)]
    return named.agg(
        *[
            F.count_if((F.trim(c.name) != "") & _typed(named, export, c).isNull()).alias(c.name)
            for c in kinds
        ]
    )


def read_strictly(
    spark: SparkSession,
    export: Export,
    path: str | list[str],
    name_pattern: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """`read_export`, but a value that is present and not readable fails the read; the files are parsed once."""
    checked = read_checked(spark, export, path, name_pattern, multiline)
    if bad := {name: n for name, n in checked.counts.items() if n}:
        raise ValueError(f"unreadable values by column: {bad}")
    return checked.rows


def _typed(df: DataFrame, export: Export, column: T.StructField) -> Column:
    kind = column.dataType
    if column.name not in df.columns:
        value = F.lit(None).cast(kind)
    elif isinstance(kind, (T.TimestampNTZType, T.DateType)):
        value = to_timestamp(column.name, export.date_formats.get(column.name)).cast(kind)
    elif isinstance(kind, T.BooleanType):
        value = flag(column.name, export.flag_mark)
    elif isinstance(kind, T.IntegerType):
        number = F.col(column.name).try_cast("double")
        value = F.when(number == F.floor(number), number.try_cast(kind))
    else:
        value = F.col(column.name).try_cast(kind)
    return value.alias(column.name)


@dataclass(frozen=True)
class LabelRule:
    """In files matching the pattern, `match` is called `label`, all else `other`."""

    name_pattern: str
    match: str
    label: str
    other: str


def read_usage(spark: SparkSession, path: str, rules: list[LabelRule]) -> DataFrame:
    """Usage files of several years as one frame, subscriptions renamed per rule."""
    export = EXPORTS["usage"]

    def part(rule: LabelRule) -> DataFrame:
        lines = read_export(spark, export, path, rule.name_pattern)
        label = two_way("subscription", rule.match, rule.label, rule.other)
        return lines.withColumn("subscription", label)

    return union_exports(*[part(rule) for rule in rules])
