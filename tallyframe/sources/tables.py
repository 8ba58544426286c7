"""Table scans, and tables of intermediate results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def work_folder(spark: SparkSession) -> str:
    """A new folder path on storage that every executor sees.

    It lies under spark.checkpoint.dir; only a session without that setting
    (a local test) falls back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="tallyframe-")
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/tallyframe-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder; later steps read that instead of computing it anew."""
    folder = work_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


#: The folder of a published dataset that lists its versions, and the kinds of tables in one.
CURRENT = "current"
LINES, DAILY = "lines", "daily"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its form."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where there is no folder."""
    files, place = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def current_version(spark: SparkSession, target: str) -> tuple[int, dict] | None:
    """The newest list of a published dataset's folders and its number; None for other paths.

    Lists are complete from the moment they have their name, and never change.
    """
    numbers = [n for n in names_in(spark, f"{target}/{CURRENT}") if n.isdigit()]
    if not numbers:
        return None
    text = spark.read.text(f"{target}/{CURRENT}/{numbers[-1]}", wholetext=True).first()[0]
    return int(numbers[-1]), json.loads(text)


def scan(
    spark: SparkSession,
    source: str,
    columns: Sequence[str] = (),
    schema: T.StructType | str | None = None,
    kind: str = LINES,
) -> DataFrame:
    """A table by name, a published dataset or a Parquet path; only the listed columns if any are given.

    With a schema, Spark need not open the files of a path to learn it. A published
    dataset may hold a table of daily totals beside its lines (`kind`).
    """
    if "/" not in source:
        df = spark.table(source)
    else:
        target = source.rstrip("/")
        reader = spark.read.schema(schema) if schema else spark.read
        found = current_version(spark, target)
        if found is None:
            df = reader.parquet(source)
        elif kind not in found[1]["folders"]:
            raise ValueError(f"{source} was published without {kind}")
        elif not found[1]["folders"][kind]:
            df = spark.createDataFrame([], T.StructType.fromJson(found[1]["schemas"][kind]))
        else:
            folders = [f"{target}/{kind}/{folder}" for folder in found[1]["folders"][kind]]
            df = reader.option("basePath", f"{target}/{kind}").parquet(*folders).drop("version")
    return df.select(*columns) if columns else df


def query(
    spark: SparkSession, text: str, frames: Mapping[str, DataFrame], **values: Any
) -> DataFrame:
    """SQL over named frames, written {name}, with bound values, written :value."""
    return spark.sql(text, args=values, **frames)
