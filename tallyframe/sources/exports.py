"""Delimited exports: many files by pattern, headers, preamble lines, line breaks in quotes.

The number of jobs does not depend on the number of files. One distributed read of the
files' first lines gives an index of file and header; every record is then parsed by the
header of its own file, and columns are found by name.

With `multiline`, quoted fields may hold line breaks and large files still stay
splittable. A first pass counts the quotes of each file block; whether a block starts
inside quotes is the running parity of the blocks before it. A second pass cuts each
block into records with that start, and the few pieces of records that cross a block
border are put together by file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.lookup import join_lookup
from tallyframe.sources.tables import stored


#: Up to so many files, one row of each is sent to every task; beyond it the lines are shuffled to them.
FEW_FILES = 50_000
#: So many lines after the preamble are looked at before all of them are, where a header comes later.
NEAR_LINES = 32
#: A quote within a quoted field is written twice.
DIALECT = {"quote": '"', "escape": '"'}
BYTE_ORDER_MARK = "\ufeff"
#: A record that starts in this block or before, its last piece in a block, the middle of one.
WHOLE, CONTINUED, OPENED = 0, 1, 2


@dataclass(frozen=True)
class Records:
    """Records as text, one per row, with the number of their header from 1, and the headers' column names."""

    rows: DataFrame  # file, header, value
    headers: list[list[str]]


def read_by_header(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    name_pattern: str | None = None,
    multiline: bool = False,
    skip: int = 0,
    file: str | None = None,
) -> DataFrame:
    """Files whose header follows `skip` free-text lines, as text columns found by name in each file.

    A column that some files lack is null there. Files without a header, and files
    without a line after it, have no rows. `file` names a column for the file's path.
    """
    return parsed(records(spark, path, sep, name_pattern, multiline, skip), sep, file)


def records(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    name_pattern: str | None = None,
    multiline: bool = False,
    skip: int = 0,
) -> Records:
    reader = spark.read.option("pathGlobFilter", name_pattern) if name_pattern else spark.read
    # where breaks count, only line feeds end a line, and carriage returns stay
    reader = reader.option("lineSep", "\n") if multiline else reader
    texts = reader.text(path)
    files = len(texts._jdf.inputFiles())
    few = files <= FEW_FILES
    # a task that reads more than one file has the first lines of the others somewhere among its lines
    alone = few and not multiline and files <= texts.rdd.getNumPartitions()
    lines = texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    index = stored(_index(lines, skip, True)) if multiline else _first_headers(lines, skip, few, alone)
    # as many rows as there are different headers
    heads = sorted(r["head"] for r in index.where("head is not null").select("head").distinct().collect())
    known = F.array_position(F.array(*[F.lit(h) for h in heads]), F.col("head")).cast("int") if heads else F.lit(None).cast("int")
    index = index.withColumn("header", known)
    cut = _across_blocks(lines, index) if multiline else _by_line(lines, index, few)
    rows = cut.where((F.trim("value") != "") & F.col("header").isNotNull())
    return Records(rows, [_names(h, sep) for h in heads])


def _names(head: str, sep: str) -> list[str]:
    """Column names of a header; empty ones are numbered and repeated ones get their number."""
    names = [n.strip() for n in next(csv.reader(io.StringIO(head), delimiter=sep))]
    low = [n.lower() for n in names]
    return [n if n and low.count(n.lower()) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]


INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("odd", T.BooleanType()),
        T.StructField("head", T.StringType()),
        T.StructField("head_lines", T.LongType()),
    ]
)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The lines of each file block in a batch; the lines of a block lie together."""
    files, blocks = batch.column("file"), batch.column("block")
    changed = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    cuts = [0, *[i + 1 for i in pc.indices_nonzero(changed).to_pylist()], batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield (files[a].as_py(), blocks[a].as_py()), batch.slice(a, b - a)


def _index(lines: DataFrame, skip: int, multiline: bool) -> DataFrame:
    """Per file block: whether it holds an odd number of quotes; for a file's first block its header.

    `head_lines` counts the lines up to the header's last one. Quotes in the preamble
    do not count, and the header is even by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, head, met, done = None, False, None, 0, []

        def close() -> None:
            if now is not None:
                whole = head is not None and not (multiline and head.count('"') % 2)
                done.append((*now, odd, head if whole else None, met))

        for batch in batches:
            for key, some in _runs(batch):
                if key != now:
                    close()
                    now, odd, head, met = key, False, None, 0
                values, at = some.column("value"), 0
                while now[1] == 0 and at < len(values) and (head is None or multiline and head.count('"') % 2):
                    line = values[at].as_py()
                    line = line.lstrip(BYTE_ORDER_MARK) if met == 0 else line
                    if met >= skip and (head is not None or line.strip()):
                        head = line if head is None else f"{head}\n{line}"
                    met, at = met + 1, at + 1
                if multiline:
                    odd ^= bool((pc.sum(pc.count_substring(values[at:], '"')).as_py() or 0) % 2)
        close()
        if done:
            columns = [pa.array(c, k) for c, k in zip(zip(*done), [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()])]
            columns[3] = pc.utf8_trim_whitespace(columns[3])
            yield pa.RecordBatch.from_arrays(columns, names=INDEX.names)

    return lines.select("file", "block", "value").mapInArrow(run, INDEX)


def _first_headers(lines: DataFrame, skip: int, few: bool, alone: bool) -> DataFrame:
    """The index of lines that each are a record; Python gets only the lines that a header is likely to be in.

    Where files have tasks of their own, each task's first lines are gathered in one scan;
    those of a file are its first lines in any case, only too few of them where a task
    reads several files, and then they are numbered, which takes two scans.
    """
    lines = lines.where("block = 0")
    near = skip + NEAR_LINES
    if alone:
        starts = stored(_task_starts(lines, near))
        index = stored(_index(starts.select("file", F.lit(0).cast("long").alias("block"), F.explode("starts").alias("value")), skip, False))
        found = index.select("file", "head", F.col("head_lines").alias("seen"))
        open_ = starts.join(found, "file", "left").where(F.col("head").isNull() & (F.coalesce("seen", F.lit(0)) < F.col("n_lines")))
        if open_.isEmpty():
            return index
    if few:
        index = stored(_index(_numbered(lines, _first_ids(lines), few).where(F.col("number") < near), skip, False))
        if index.where(F.col("head").isNull() & (F.col("head_lines") >= near)).isEmpty():
            return index
    return stored(_index(lines, skip, False))


def _task_starts(lines: DataFrame, near: int) -> DataFrame:
    """Per file its number of lines, and those among the first lines of the task that reads it, in their order."""
    # ids count each task's lines from 0 in their lower 33 bits
    early = F.col("id").bitwiseAND((1 << 33) - 1) < near
    gathered = F.sort_array(F.collect_list(F.when(early, F.struct("id", "value"))))
    starts = F.transform(gathered, lambda line: line["value"]).alias("starts")
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), starts)


def _first_ids(lines: DataFrame) -> DataFrame:
    return lines.where("block = 0").groupBy("file").agg(F.min("id").alias("first_id"))


def _numbered(lines: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """Lines with what is known of their file and, in its first block, their number from 0.

    Only a file's first block holds its first lines, and row ids rise along a task's
    input, so a line's number is its id less the lowest id of its file's first block.
    That is one row per file: sent to every task, so that the lines stay where they are
    read and in their order, or, of very many files, looked up so that a file with very
    many lines is spread over tasks.
    """
    placed = lines.join(F.broadcast(known), "file") if few else join_lookup(lines, known, "file", spread_by=["id"])
    return placed.withColumn("number", F.when(F.col("block") == 0, F.col("id") - F.col("first_id")))


def _by_line(lines: DataFrame, index: DataFrame, few: bool) -> DataFrame:
    """Every line after the header is a record."""
    known = _first_ids(lines).join(index.select("file", "header", "head_lines"), "file")
    after = F.col("number").isNull() | (F.col("number") >= F.col("head_lines"))
    return _numbered(lines, known, few).where(after).select("file", "header", "value")


CUT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("header", T.IntegerType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)


def _across_blocks(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Records by the parity of quotes, which each block starts with what the blocks before it leave."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file")
    starts = index.select(
        "file",
        "block",
        F.max("header").over(of_file).alias("header"),
        (F.pmod(F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)), F.lit(2)) == 1).alias("inside"),
        F.when(F.col("block") == 0, F.col("head_lines")).otherwise(F.lit(0).cast("long")).alias("first"),
    )
    lost = F.raise_error(F.lit("a file was split in other blocks while it was read"))
    placed = lines.join(starts, ["file", "block"], "left").withColumn("inside", F.coalesce("inside", lost.cast("boolean")))
    # a join may shuffle; lines of a block go back into their order
    placed = placed.sortWithinPartitions("file", "block", "id").select("file", "block", "header", "inside", "first", "value")
    pieces = placed.mapInArrow(_cut, CUT)
    whole = pieces.where(F.col("piece") == WHOLE).select("file", "header", "value")
    crossing = pieces.where(F.col("piece") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = crossing.withColumn("nth", F.sum((F.col("piece") == OPENED).cast("int")).over(order))
    put = F.sort_array(F.collect_list(F.struct("block", "piece", "value")))
    joined = numbered.groupBy("file", "header", "nth").agg(F.concat_ws("\n", F.transform(put, lambda p: p["value"])).alias("value"))
    return whole.unionByName(joined.select("file", "header", "value")).withColumn("value", F.regexp_replace("value", "\r$", ""))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each block, and its first and last pieces that belong to a record of several blocks."""
    now, header, open_lines, piece, left = None, None, [], WHOLE, 0
    out: list[tuple] = []

    def close() -> None:
        if open_lines:
            out.append((*now, header, piece, "\n".join(open_lines)))
            open_lines.clear()

    def made() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=CUT.names)
        out.clear()
        return batch

    inside = False
    for batch in batches:
        for key, some in _runs(batch):
            if key != now:
                close()
                now, header, left = key, some.column("header")[0].as_py(), some.column("first")[0].as_py()
                inside = some.column("inside")[0].as_py()
                piece = CONTINUED if inside else OPENED
            drop = min(left, some.num_rows)
            left -= drop
            some = some.slice(drop)
            values = some.column("value")
            odd = pc.equal(pc.bit_wise_and(pc.count_substring(values, '"'), 1), 1)
            if not inside and not pc.any(odd).as_py():
                if some.num_rows:
                    if out:
                        yield made()
                    columns = [some.column(c) for c in ("file", "block", "header")]
                    columns += [pa.repeat(pa.scalar(WHOLE, pa.int32()), some.num_rows), values]
                    yield pa.RecordBatch.from_arrays(columns, names=CUT.names)
                continue
            for line, turns in zip(values.to_pylist(), odd.to_pylist()):
                open_lines.append(line)
                inside ^= turns
                if not inside:
                    if piece == OPENED:
                        out.append((*now, header, WHOLE, "\n".join(open_lines)))
                        open_lines.clear()
                    else:
                        close()
                        piece = OPENED
        if out:
            yield made()
    close()
    if out:
        yield made()


def parsed(found: Records, sep: str = ",", file: str | None = None) -> DataFrame:
    """The records as text columns, each by its own header; a column that a header lacks is null."""
    spelled: dict[str, str] = {}
    for names in found.headers:
        for name in names:
            spelled.setdefault(name.lower(), name)

    def by(names: list[str]) -> Column:
        held = {n.lower() for n in names}
        layout = T.StructType([T.StructField(spelled[n.lower()], T.StringType()) for n in names])
        row = F.from_csv("value", _ddl(layout), {"sep": sep, **DIALECT})
        if len(found.headers) == 1:
            return row
        # parsed once, then brought to the columns of all headers
        full = lambda r: F.struct(*[(r.getField(n) if low in held else F.lit(None).cast("string")).alias(n) for low, n in spelled.items()])
        return F.transform(F.array(row), full)[0]

    own = [F.col("file").alias(file)] if file else []
    if not found.headers:
        return found.rows.select(*own)
    rows = [by(names) for names in found.headers]
    row = rows[0]
    if len(rows) > 1:
        row = F.when(F.col("header") == 1, rows[0])
        for number, other in enumerate(rows[1:], 2):
            row = row.when(F.col("header") == number, other)
    columns = [F.col("row").getField(n).alias(n) for n in spelled.values()]
    return found.rows.select(*own, row.alias("row")).select(*[F.col(f"`{file}`")] * bool(file), *columns)


def _ddl(layout: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in layout)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    name_pattern: str | None = None,
    timestamp_format: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Files with a header line, typed by `schema`; split by Spark at any size.

    A header that names other columns than the schema, or in another order, fails
    the read. With `multiline`, quoted fields may hold line breaks; a file is
    then read by one task.
    """
    reader = spark.read.schema(schema).options(header=True, sep=sep, multiLine=multiline, **DIALECT)
    reader = reader.option("enforceSchema", False)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    return reader.csv(path)


def read_after_preamble(
    spark: SparkSession,
    path: str | list[str],
    skip: int,
    columns: Sequence[str] = (),
    sep: str = ",",
    name_pattern: str | None = None,
    multiline: bool = False,
    file: str | None = None,
) -> DataFrame:
    """Delimited files whose header follows `skip` free-text lines, as text columns.

    `columns` picks some columns by header name. All files must have the same header;
    one that differs fails the read.
    """
    found = records(spark, path, sep, name_pattern, multiline, skip)
    if not found.headers:
        raise ValueError(f"no file has a header after {skip} lines")
    if len(found.headers) > 1:
        raise ValueError(f"header is not {found.headers[0]!r} in all files, but also {found.headers[1:]!r}")
    rows = parsed(found, sep, file)
    return rows.select(*[file] * bool(file), *[f"`{name}`" for name in columns]) if columns else rows


def union_exports(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column missing from one frame is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
