"""Vector codes: product quantisation in integers, with LAESA pivots in place of full distance tables.

Distances from every part to a few fixed pivots are computed once and stored. Each round computes only the distances
from pivots to codebook entries; |d(part, pivot) - d(pivot, entry)| is a lower bound of the distance from part to entry, so
entries are tried in the order of their bounds and the rest is skipped once a bound exceeds the best exact distance.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
PIVOTS = 4
#: Rows that a task holds as integers at a time.
ROWS = 4096
#: Pivot distances are stored in 32 bits: what a bound may lose by that, relative to the two distances.
SLACK = 4e-7


def largest(dim: int) -> int:
    """Integer components stay below this, so that sums of squares over a whole vector fit 64 bits."""
    return math.isqrt(2**60 // max(dim, 1)) // 2


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two integer matrices; the sums of squares are exact."""
    return np.sqrt(np.square(a[:, None, :] - b[None, :, :]).sum(axis=2).astype(float))


def nearest(cells: np.ndarray, near: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance) of every row of `cells`, and the number of distances evaluated.

    `near` has the distances of the rows to the pivots. Ties go to the lower index. An entry is left out only if its lower
    bound is above the best distance so far, so the result is that of all comparisons.
    """
    at = distances(book, pivots)
    bound = (np.abs(near[:, None, :] - at[None]) - SLACK * (near[:, None, :] + at[None])).max(axis=2)
    bound = np.square(np.maximum(bound, 0)) * (1 - 1e-9)
    order = np.argsort(bound, axis=1, kind="stable")
    code = np.full(len(cells), len(book), np.int64)
    best = np.full(len(cells), np.iinfo(np.int64).max, np.int64)
    open_, done = np.arange(len(cells)), 0
    for k in range(len(book)):
        entry = order[open_, k]
        go = bound[open_, entry] <= best[open_]
        open_, entry = open_[go], entry[go]
        if not len(open_):
            break
        found = np.square(cells[open_] - book[entry]).sum(axis=1)
        done += len(open_)
        better = (found < best[open_]) | ((found == best[open_]) & (entry < code[open_]))
        code[open_[better]], best[open_[better]] = entry[better], found[better]
    return code, best, done


def blocks(batch: pa.RecordBatch, parts: int, first: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their integers (row, part, position) and pivot distances (row, part, pivot) from columns `first` on."""
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        n = part.num_rows
        cells, near = (part.column(first + k).flatten().to_numpy(zero_copy_only=False) for k in range(2))
        yield part, cells.astype(np.int64).reshape(n, parts, -1), near.astype(float).reshape(n, parts, -1)


def start(df: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """Integers (entry, part, position) of the usable rows with the smallest ids; None without any. `df` has id and vector."""
    size = F.size("vector")
    usable = df.where((size > 0) & (size % parts == 0) & F.forall("vector", lambda x: F.abs(x) * SCALE < F.sqrt(F.lit(2.0**58) / size)))
    by = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = usable.orderBy(*by).limit(entries).collect()
    if not head:
        return None
    dim = len(head[0]["vector"])
    if any(len(r["vector"]) != dim for r in head):
        head = usable.where(size == dim).orderBy(*by).limit(entries).collect()
    return np.floor(np.array([r["vector"] for r in head], float) * SCALE).astype(np.int64).reshape(len(head), parts, -1)


def integers(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, label, cells, near): integers of each vector and distances of its parts to the pivots; NULL where a vector doesn't fit."""
    parts, dim = pivots.shape[0], pivots.shape[0] * pivots.shape[2]
    most = largest(dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                vectors = batch.column(2)
                fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == dim
                x = np.floor(vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE)
                small = (np.abs(x) < most).all(axis=1)
                fits[fits] = small
                x = x[small].astype(np.int64).reshape(-1, parts, dim // parts)
                near = np.stack([distances(x[:, p], pivots[p]) for p in range(parts)], axis=1) if len(x) else np.zeros((0, parts, pivots.shape[1]))
                sides = []
                for values, kind in ((x, np.int32), (near, np.float32)):
                    ends = np.concatenate([[0], np.cumsum(fits * math.prod(values.shape[1:]))]).astype(np.int32)
                    sides.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().astype(kind)), mask=pa.array(~fits)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides], names=["id", "label", "cells", "near"])

    schema = T.StructType([df.schema["id"], df.schema["label"], T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("near", T.ArrayType(T.FloatType()))])
    return df.select("id", "label", "vector").mapInArrow(work, schema)


def improve(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks after one round, and the number of distances evaluated; a task returns sums for each entry only."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        done = 0
        for batch in batches:
            for _, cells, near in blocks(batch, parts, 0):
                for p in range(parts):
                    code, _, n = nearest(cells[:, p], near[:, p], books[p], pivots[p])
                    done += n
                    ours = (np.arange(entries)[:, None] == code[None]).astype(np.int64)
                    total[p, :, :width] += ours @ cells[:, p]
                    total[p, :, width] += ours.sum(axis=1)
        at = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], done))], names=["at", "value"])

    # At most one row for each component of the codebooks.
    found = rows.mapInArrow(work, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in found:
        if r["at"] >= 0:
            total.reshape(-1)[r["at"]] = r["value"]
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books), sum(r["value"] for r in found if r["at"] < 0)


def coded(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(id, label, code, error) of all rows; NULL code and error where there are no integers."""
    parts = books.shape[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(2).is_valid()
            bare = batch.filter(pc.invert(there))
            nulls = [pa.nulls(bare.num_rows, pa.string()), pa.nulls(bare.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([bare.column(0), bare.column(1), *nulls], names=["id", "label", "code", "error"])
            for part, cells, near in blocks(batch.filter(there), parts, 2):
                codes, error = np.zeros((len(cells), parts), np.uint8), np.zeros(len(cells), np.int64)
                for p in range(parts):
                    code, best, _ = nearest(cells[:, p], near[:, p], books[p], pivots[p])
                    codes[:, p] = code
                    error += best
                text = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(work, schema)


def codebooks(rows: DataFrame, first: np.ndarray, pivots: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """Codebooks (part, entry, position) after `rounds` rounds over all `rows`, and the distances that each round evaluated."""
    books, done = first, []
    ours = rows.where("cells IS NOT NULL").select("cells", "near")
    for _ in range(rounds):
        books, n = improve(ours, books, pivots)
        done.append(n)
    return books, done


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for every row whose vector and all its components are there and finite.

    Components become floor(4096 x). Codebooks start as the parts of the `entries` smallest ids (fewer rows: fewer
    entries), NULL ids last, ties by the vector; `pivots` of those entries, the first ones, stay the pivots of all rounds.
    Each round covers all rows. `error` is the sum of the squared distances over parts, `label_error` its sum over rows
    with an equal label, NULLs together. A vector that is empty, whose length differs from that of the smallest id or
    doesn't divide into `parts`, or with a component too large for exact 64-bit sums has a NULL code and error and takes
    no part in the codebooks. Repeated rows stay and weigh each time. Other columns are ignored; an empty table gives an
    empty one. `entries` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: entries must be 1 to 256")
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kept = named.where(finite(F.col("vector")))
    first = start(kept.select("id", "vector"), entries, parts)
    if first is None:
        out = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        sha = None
    else:
        books = np.ascontiguousarray(first.transpose(1, 0, 2))
        fixed = books[:, :pivots].copy()
        rows = cut_lineage(integers(kept, fixed))
        books, _ = codebooks(rows, books, fixed, rounds)
        out, sha = cut_lineage(coded(rows, books, fixed)), digest(books)
    sums = out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
