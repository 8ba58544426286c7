"""Delimited output and the publishing of typed datasets.

A published dataset is a folder of complete versions, which never change once they are
listed, and of small numbered lists that name the folders of each version. A list is
written last, under another name, and then renamed, so readers see the old version or the
new one, whole, whatever step a run stops at. Folders that no current list names are
deleted when they are old.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyframe.functions.dates import month_key
from tallyframe.schemas import DATASETS, check_schema
from tallyframe.sources.exports import DIALECT
from tallyframe.sources.tables import (
    CURRENT,
    DAILY,
    LINES,
    current_version,
    file_system,
    names_in,
    work_folder,  # noqa: F401  (used by name from here)
)

MONTH = "report_month"


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited files with a header line, replacing the old ones."""
    writer = df.write.mode("overwrite").options(header=True, sep=sep, **DIALECT)
    writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)


def write_by(df: DataFrame, path: str, *partition: str) -> None:
    """Parquet partitioned by the given columns, replacing the old copy.

    The rebalance hint gathers small partitions and splits a hot one over
    several tasks, so neither many tiny files nor one giant file results.
    """
    balanced = df.hint("rebalance", *partition)
    balanced.write.mode("overwrite").partitionBy(*partition).parquet(path)


@dataclass(frozen=True)
class Publication:
    """How one dataset gets from its export to its published copy."""

    dataset: str
    read: Callable[[SparkSession], DataFrame]
    target: str
    month_of: str | None = None  # partition by the month of this date column
    only_its_months: bool = False  # leave published months alone that the export lacks
    daily: Callable[[DataFrame], DataFrame] | None = None  # totals of the lines, kept beside them
    keep_days: float = 7.0  # folders that are no longer listed stay this long for running readers

    @property
    def schema(self) -> T.StructType:
        return DATASETS[self.dataset]


def publish(spark: SparkSession, job: Publication) -> str:
    """Read, check against the dataset's schema, publish a new version; return the target.

    The new copy is checked again as stored before it is listed, so a failed run leaves
    the old version as it was. With `only_its_months`, the new version names the new
    folders of the months that the export holds and the old folders of all others. The
    daily totals are computed from the stored lines, for the new months only.
    """
    if (job.only_its_months or job.daily) and not job.month_of:
        raise ValueError("only_its_months and daily need month_of")
    target, version = job.target.rstrip("/"), f"version={uuid.uuid4().hex}"
    lines = check_schema(job.read(spark), job.schema)
    if job.month_of:
        lines = lines.withColumn(MONTH, month_key(job.month_of))
    found = current_version(spark, target)
    tables = {LINES: lines}
    schemas, folders = {}, {}
    for kind in (LINES, DAILY) if job.daily else (LINES,):
        base = f"{target}/{kind}"
        table = tables[kind]
        if job.month_of:
            write_by(table, f"{base}/{version}", MONTH)
        else:
            table.write.parquet(f"{base}/{version}")
        schemas[kind] = table.schema.jsonValue()
        folders[kind] = [version]
        if job.month_of:
            folders[kind] = [f"{version}/{n}" for n in names_in(spark, f"{base}/{version}") if n.startswith(f"{MONTH}=")]
        stored = spark.createDataFrame([], table.schema)
        if folders[kind]:
            stored = spark.read.option("basePath", base).parquet(*[f"{base}/{f}" for f in folders[kind]])
        if kind == LINES:
            check_schema(stored.drop(MONTH, "version"), job.schema)
            if job.daily:
                tables[DAILY] = job.daily(stored.drop("version"))
    if job.only_its_months and found:
        for kind, old in found[1]["folders"].items():
            if kind not in folders:
                raise ValueError(f"{target} holds {kind} too; publish all months to change that")
            new = {f.split("/")[1] for f in folders[kind]}
            if any("/" not in f for f in old):
                raise ValueError(f"{target} is not published by month")
            folders[kind] = sorted([f for f in old if f.split("/")[1] not in new] + folders[kind], key=lambda f: f.split("/")[1])
        if set(folders) != set(found[1]["folders"]):
            raise ValueError(f"{target} was published without {DAILY}; publish all months to change that")
    _list(spark, target, (found[0] if found else 0) + 1, {"folders": folders, "schemas": schemas})
    _clear(spark, target, folders, job.keep_days)
    return job.target


def _list(spark: SparkSession, target: str, number: int, content: dict) -> None:
    """The step that makes a version current: a complete list gets its name."""
    files, new = file_system(spark, f"{target}/{CURRENT}/.{uuid.uuid4().hex}")
    out = files.create(new, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, name = file_system(spark, f"{target}/{CURRENT}/{number:08d}")
    if files.exists(name) or not files.rename(new, name):
        files.delete(new, False)
        raise OSError(f"version {number} of {target} was published by someone else meanwhile")


def _clear(spark: SparkSession, target: str, folders: dict[str, list[str]], keep_days: float) -> None:
    """Delete version folders that the current list does not name, and lists before it, when they are old."""
    before = (time.time() - keep_days * 86_400) * 1_000

    def drop(path: str) -> None:
        files, place = file_system(spark, path)
        if files.getFileStatus(place).getModificationTime() < before:
            files.delete(place, True)

    for kind in (LINES, DAILY):
        named = {f.split("/")[0] for f in folders.get(kind, [])}
        for version in set(names_in(spark, f"{target}/{kind}")) - named:
            drop(f"{target}/{kind}/{version}")
    for number in names_in(spark, f"{target}/{CURRENT}")[:-1]:
        drop(f"{target}/{CURRENT}/{number}")


def publish_all(spark: SparkSession, jobs: list[Publication]) -> dict[str, str]:
    return {job.dataset: publish(spark, job) for job in jobs}
