"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidepool.functions.kernels import map_arrow
from tidepool.tables import drop_stored, new_path, stored

__all__ = ["drop_stored", "new_path", "stored"]  # tables between steps

#: Bytes of text that one step of a Python kernel works on at a time.
SLICE_BYTES = 4 << 20


#: By operator: how to empty the caches that it keeps in a Python worker between tasks.
CACHES: dict[str, Callable[[], None]] = {}
_last = ""


def using(name: str) -> None:
    """Called by an operator's kernel: when a worker goes over to another operator, the caches of the
    others are emptied, so that a worker holds one operator's at a time."""
    global _last
    if name != _last:
        for other, clear in CACHES.items():
            if other != name:
                clear()
        _last = name


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Let Arrow batches have some megabytes at most: rows are whole texts, and both the JVM and the worker
    hold a batch. A smaller setting of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or int("".join(c for c in now if c.isdigit() or c == "-") or 0) > mb << 20 or now.startswith("-"):
        spark.conf.set(name, f"{mb << 20}b")


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod m. A null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(m)), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `budget` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(at, to - at)
        at = to


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts as str; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def free_name(columns: list[str], wish: str) -> str:
    """A column name that clashes with none of `columns` (Spark compares without case)."""
    low = {c.lower() for c in columns}
    while wish.lower() in low:
        wish = f"_{wish}"
    return wish


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, kernel: Callable[[pa.RecordBatch], dict], state: Callable | None = None) -> DataFrame:
    """id_col and the kernel's columns, for each row. The kernel gets slices with the columns `key` and
    `text` and returns arrays for the columns of `schema` after the key."""
    bounded_batches(df.sparkSession)
    key_type = dict(df.dtypes)[id_col]
    narrow = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["key", *(x.split()[0] for x in schema.split(", "))]

    owner = kernel.__module__

    def run(batches):
        using(owner)
        for batch in batches:
            for part in slices(batch, "text"):
                got = kernel(part)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names[1:]))], names)
        release()

    out = narrow.mapInArrow(run, f"key {key_type}, {schema}")
    return out.withColumnRenamed("key", id_col)


def annotate(df: DataFrame, text_col: str, schema: str, kernel: Callable[[pa.RecordBatch], dict]) -> tuple[DataFrame, str]:
    """All columns of df and one struct column with the kernel's results, under a name that clashes with
    none; the name comes back too. The kernel gets slices whose column `text` holds the text."""
    bounded_batches(df.sparkSession)
    name = free_name(df.columns, "annotation")
    names = [x.split()[0] for x in schema.split(", ")]
    at = df.columns.index(text_col)
    columns, owner = df.columns, kernel.__module__

    def run(batches):
        using(owner)
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            with_text = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["row", "text"])
            for part in slices(with_text, "text"):
                got = kernel(part)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names)]
                rows = batch.slice(part.column("row")[0].as_py(), part.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(arrays, names)], [*columns, name])
        release()

    typed = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(", "))
    out = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(f"struct<{typed}>"))])
    return map_arrow(df, run, out), name


def own_columns(df: DataFrame) -> list[str]:
    """The columns' names, quoted: a dot in a name isn't a field's."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]
