"""Sums of arrays per group that are made in the tasks and merged as a tree.

A task holds one array for each group that it meets, so a row never becomes a row for each of its elements. The
arrays of a group are first merged in salted parts, so a group that every task meets is spread as well.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20
SALTS = 16
_NUMBERS = T.ArrayType(T.DoubleType())


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of the longest row's width; NULLs, of lists as well, and missing ends are NaN."""
    if not pa.types.is_list(column.type):
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.full((len(column), sizes.max(initial=0)), np.nan)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat
    return out


def task_sums(
    df: DataFrame, by: Sequence[str], values: Sequence[str], make: Callable[[tuple, list[np.ndarray]], dict[tuple, np.ndarray]],
    more: Sequence[T.StructField] = (),
) -> DataFrame:
    """(by, more, sums): what `make` gives for a group's rows in a batch, summed over the batches of a task.

    `make` gets the group's key and its rows of each of the `values` as numpy arrays (lists as matrices), and returns arrays
    by the values of the columns `more`. Arrays of one group that differ in length are summed from the front.
    """
    by = list(by)
    schema = T.StructType([*[df.schema[c] for c in by], *more, T.StructField("sums", _NUMBERS)])
    names = [f.name for f in schema]
    kinds = [f.type for f in df.select(*by).limit(0).toArrow().schema] if by else []
    more_kinds = [f.type for f in df.sparkSession.createDataFrame([], T.StructType(list(more))).toArrow().schema] if more else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def passed() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate([*kinds, *more_kinds])]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], names=names)
            held.clear()
            return out

        for batch in batches:
            index: dict[tuple, int] = {}
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(by)))) if by else [()] * batch.num_rows
            code = np.fromiter((index.setdefault(k, len(index)) for k in keys), np.int64, batch.num_rows)
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(index) + 1))
            columns = [matrix(batch.column(len(by) + i)) for i in range(len(values))]
            for key, at in index.items():
                rows = order[ends[at]:ends[at + 1]]
                for extra, made in make(key, [c[rows] for c in columns]).items():
                    old = held.get((*key, *extra))
                    if old is None:
                        held[(*key, *extra)] = made
                    else:
                        long, short = (old, made) if len(old) >= len(made) else (made.copy(), old)
                        long[:len(short)] += short
                        held[(*key, *extra)] = long
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield passed()
        if held:
            yield passed()

    return df.select(*by, *values).mapInArrow(work, schema)


def add_arrays(arrays: Column) -> Column:
    """Element-wise sum of an array of arrays; shorter ones end early."""
    zero = F.lit(0.0)
    return F.aggregate(arrays, F.array().cast(_NUMBERS), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero)))


def merge_sums(partial: DataFrame, by: Sequence[str], sums: str = "sums") -> DataFrame:
    """(by, sums): the arrays of each group added up, first in salted parts."""
    salted = partial.withColumn("__salt", F.spark_partition_id() % SALTS)
    once = salted.groupBy(*by, "__salt").agg(add_arrays(F.collect_list(sums)).alias(sums))
    return once.groupBy(*by).agg(add_arrays(F.collect_list(sums)).alias(sums))


def vector_sums(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """(by, counts, sums, squares): per position of an array column, the number of values that are there, their sum and sum of squares.

    NULL and NaN are not there. Vectors may differ in length; a group without vectors has empty arrays.
    """

    def make(_, columns: list[np.ndarray]) -> dict:
        vectors = columns[0][:, :max(int(columns[1].max()), 0)]
        there = ~np.isnan(vectors)
        x = np.where(there, vectors, 0)
        return {(): np.stack([there.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)], axis=1).ravel()}

    # The three alternate, so arrays of different lengths still add up.
    sized = df.select(*by, vec, F.coalesce(F.size(vec), F.lit(-1)).alias("__size"))
    made = merge_sums(task_sums(sized, by, [vec, "__size"], make), by).withColumnRenamed("sums", "__all")
    some, empty = F.size("__all") > 0, F.array().cast(_NUMBERS)
    last = F.floor(F.size("__all") / 3).cast("int") - 1

    def take(shift: int) -> Column:
        return F.when(some, F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at("__all", 3 * i + 1 + shift))).otherwise(empty)

    return made.select(*by, take(0).alias("counts"), take(1).alias("sums"), take(2).alias("squares"))
