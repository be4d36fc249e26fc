"""Comparisons of many pairs of sequences at once, in numpy over Arrow batches.

What Spark's higher-order functions say letter by letter is done here for whole batches; pairs whose
sequences have the same two lengths are compared as matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Letters that are compared at a time.
_CELLS = 1 << 22


def letters(seqs: list[str], size: int) -> np.ndarray:
    """The codes of sequences of one length, a row each."""
    data = "".join(seqs)
    if data.isascii():
        return np.frombuffer(data.encode(), np.uint8).reshape(len(seqs), size)
    return np.frombuffer(data.encode("utf-32-le"), "<u4").reshape(len(seqs), size)


def by_lengths(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, letters of a, letters of b) for pairs of like lengths, in parts of bounded size."""
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    order = np.lexsort((lb, la))
    cuts = np.flatnonzero(np.r_[True, (np.diff(la[order]) != 0) | (np.diff(lb[order]) != 0)]) if len(a) else []
    for i, j in zip(cuts, [*cuts[1:], len(a)]):
        step = max(1, _CELLS // max(1, int(la[order[i]] + lb[order[i]])))
        for k in range(i, j, step):
            rows = order[k : min(k + step, j)]
            yield rows, letters([a[r] for r in rows], int(la[rows[0]])), letters([b[r] for r in rows], int(lb[rows[0]]))


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = min(x.shape[1], y.shape[1])
    return x[:, :n] != y[:, :n]


def compared(df: DataFrame, a: str, b: str, schema: str, compare: Callable[[np.ndarray, np.ndarray, dict], dict], extra: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that `compare` makes of the letters of columns a and b, and of the columns
    `extra`; rows for which it gives null in its first column are dropped, and the columns `drop`."""
    added = _parse_datatype_string(schema)
    keep = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            out: list[list] = [[None] * n for _ in added.fields]
            more = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in extra}
            for rows, x, y in by_lengths(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                got = compare(x, y, {c: v[rows] for c, v in more.items()})
                valid = got.pop("valid", np.ones(len(rows), bool))
                for k, f in enumerate(added.fields):
                    for r, v in zip(rows[valid].tolist(), got[f.name][valid].tolist()):
                        out[k][r] = v
            ok = pa.array([v is not None for v in out[0]], pa.bool_())
            arrays = [batch.column(c) for c in names] + [pa.array(o, pa.int32()) for o in out]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *(f.name for f in added.fields)]).filter(ok)

    return map_arrow(df, run, StructType([*keep, *added.fields]))


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow for tables with any column names: Spark takes a dot in a name for a field's, so such
    columns have other names in the batches."""
    names = [f"_{i}" if set(c) & set(".`") else c for i, c in enumerate(df.columns)]
    return (df if names == df.columns else df.toDF(*names)).mapInArrow(run, schema)


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the letters of all strings, one after the other; number of letters of each). A null string
    is empty. Strings of ASCII letters are read where they lie, without making Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    if data.max() < 128:
        return data, np.diff(ends)
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def text_of(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """The strings that stand one after the other in ASCII codes."""
    offsets = np.r_[0, np.cumsum(lens)].astype(np.int32)
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes()))


def rows_of(lens: np.ndarray, cells: int = _CELLS) -> Iterator[tuple[int, int]]:
    """Runs of rows whose matrix, as wide as the longest of them, has at most `cells` cells, or one row."""
    at = 0
    while at < len(lens):
        width = np.maximum.accumulate(np.maximum(lens[at : at + cells], 1))
        n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), cells, side="right")))
        yield at, min(at + n, len(lens))
        at += n


def padded(data: np.ndarray, lens: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix with a row for each string, filled up at its end; which cells are letters)."""
    width = int(lens.max(initial=0))
    inside = np.arange(width)[None] < lens[:, None]
    if inside.all():
        return data.reshape(len(lens), width), inside
    out = np.full(inside.shape, fill, data.dtype)
    out[inside] = data
    return out, inside


def matrices(column: pa.Array, fill: int = 0, cells: int = _CELLS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, matrix, which cells are letters) of a batch's strings, in parts of bounded size."""
    data, lens = codes(column)
    ends = np.r_[0, np.cumsum(lens)]
    for i, j in rows_of(lens, cells):
        yield (i, j, *padded(data[ends[i] : ends[j]], lens[i:j], fill))


def histogram(df: DataFrame, schema: str, sizes: tuple[int, ...], place: Callable) -> DataFrame:
    """Counts (schema, n) of numbered cells, summed. `place` gives for a batch the numbers of its cells in a
    table of these sizes; a task sends one row for each cell that it has met, so what is shuffled is
    bounded by the table and not by the rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        total = np.zeros(int(np.prod(sizes)), np.int64)
        for batch in batches:
            for at in place(batch):
                total += np.bincount(at, minlength=len(total))
        found = np.flatnonzero(total)
        at = np.unravel_index(found, sizes)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in at), pa.array(total[found])], [*names, "n"])

    return df.mapInArrow(run, f"{schema}, n bigint").groupBy(*names).agg(F.sum("n").alias("n"))
