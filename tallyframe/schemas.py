"""One explicit schema per dataset, and the check that ingest applies.

Timestamps carry no zone, so month and day grouping never depends on the
session time zone. Cloud costs keep six decimals because metered lines are
often below one cent; invoices are whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COST = T.DecimalType(18, 6)
MONEY = T.DecimalType(18, 2)
HOURS = T.DecimalType(18, 6)  # a log line may hold 7.5 hours


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _int, _real = T.StringType(), T.IntegerType(), T.DoubleType()
_date, _stamp, _flag = T.DateType(), T.TimestampNTZType(), T.BooleanType()

USAGE = _struct(
    usage_date=_stamp, category=_text, subscription=_text, resource_group=_text, cost=COST
)
SPONSOR = _struct(
    date=_stamp,
    service_name=_text,
    service_type=_text,
    service_region=_text,
    service_resource=_text,
    cost=COST,
)
RATES = _struct(
    employee=_text,
    project=_text,
    init_rate=_real,
    fte=_real,
    rate=_real,
    period=_stamp,
    rank=_text,
    level=_text,
    target=_real,
    billed=_real,
    indiv_eligibility=_int,
)
HOLIDAY = _struct(holiday=_date, holiday_name=_text)
INVOICE = _struct(
    client=_text,
    inv_date=_date,
    due_date=_date,
    inv_amount=MONEY,
    date_paid=_date,
    payment_amount=MONEY,
    tx_type=_text,
    inv_yr=_int,
    inv_mon=_int,
    payment_yr=_int,
    payment_mon=_int,
)
EMPLOYEE = _struct(
    employee=_text,
    grp=_text,
    resigned=_flag,
    last_day=_date,
    rank=_text,
    level=_text,
    start=_date,
    account=_text,
    grp2=_text,
    company=_text,
    include=_int,
    remarks=_text,
    billed_project=_text,
    activities=_text,
)
EOD = _struct(employee_name=_text, date=_stamp, account=_text, hours=HOURS, minutes=HOURS)

DATASETS = {
    "usage": USAGE,
    "sponsor": SPONSOR,
    "rates": RATES,
    "holiday": HOLIDAY,
    "invoice": INVOICE,
    "employee": EMPLOYEE,
    "eod": EOD,
}


class SchemaMismatch(ValueError):
    """A frame lacks a column of its dataset, or holds it with another type."""


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return `df` with exactly the expected columns, in order, or raise."""
    actual = {field.name: field.dataType for field in df.schema}
    wrong = [
        f"{field.name}: expected {field.dataType.simpleString()}, got "
        + (actual[field.name].simpleString() if field.name in actual else "nothing")
        for field in expected
        if actual.get(field.name) != field.dataType
    ]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df.select(expected.names)
