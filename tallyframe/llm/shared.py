"""Helpers that several operators use: scratch tables, row-wise Arrow steps, words."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder of the cluster.

    A machine-local folder is made only in local mode where ``spark.checkpoint.dir`` is
    unset, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="tallyframe-")
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there."""
    path = scratch_folder(frame.sparkSession)
    (frame.coalesce(partitions) if partitions else frame).write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Texts that a Python step holds at a time.
SLICE_BYTES = 2 << 20


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, or until another owner asks for one."""
    holder = sys.modules.setdefault("tallyframe_worker", types.ModuleType("tallyframe_worker"))
    for other in set(holder.__dict__.get("owners", ())) - {owner}:
        del holder.owners[other]
    return holder.__dict__.setdefault("owners", {}).setdefault(owner, {})


def slices(batch: pa.RecordBatch, texts: Callable[[pa.RecordBatch], Iterable[pa.Array]]) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take a few megabytes; one row at least."""
    sizes = np.full(batch.num_rows, 64, np.int64)
    for column in texts(batch):
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def annotated(
    docs: DataFrame,
    inputs: Sequence[str],
    step: Callable[..., Sequence[pa.Array]],
    fields: Sequence[T.StructField],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """One output row per row: the kept columns as the struct ``row``, then ``fields``.

    ``step`` gets an iterator of tuples of Arrow arrays, one array per input,
    and yields the arrays of ``fields``; it sees a few megabytes at a time. Since the
    kept columns travel inside ``row``, their names never clash with the new ones, and
    an input that is kept travels there alone.
    """
    keep = docs.columns if keep is None else list(keep)
    apart = [name for name in inputs if name not in keep]
    picked = docs.select(
        F.struct(*[docs[name] for name in keep]).alias(ROW),
        *[docs[name].alias(f"__in{i}") for i, name in enumerate(apart)],
    )
    places = [(True, keep.index(name)) if name in keep else (False, 1 + apart.index(name)) for name in inputs]
    schema = T.StructType([picked.schema[ROW], *fields])
    names = [f.name for f in schema]
    kinds = [_arrow_kind(f.dataType) for f in fields]

    def given(batch: pa.RecordBatch) -> tuple[pa.Array, ...]:
        return tuple(batch.column(0).field(at) if kept else batch.column(at) for kept, at in places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []

        def parts():
            for batch in batches:
                for some in slices(batch, given):
                    rows.append(some.column(0))
                    yield given(some)

        for arrays in step(parts()):
            made = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(arrays, kinds)]
            yield pa.RecordBatch.from_arrays([rows.pop(0), *made], names=names)

    return picked.mapInArrow(run, schema)


def _arrow_kind(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give the remainder of empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


# The bytes that a byte-level vocabulary writes as themselves.
PLAIN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [b for some in PLAIN_BYTES for b in some]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


KINDS = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def field(name: str, kind: str | T.DataType, many: bool = False) -> T.StructField:
    kind = KINDS[kind] if isinstance(kind, str) else kind
    return T.StructField(name, T.ArrayType(kind) if many else kind)
