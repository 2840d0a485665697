"""Vector cells: centres over all rows, exact pruning by the triangle inequality, and probes for a wanted recall.

Memory rows lie in the cell of their nearest centre. A cell can be skipped for a query if the distance to its centre minus
its radius exceeds the query's k-th distance so far, which is exact; or after a number of cells that was measured to
give the wanted recall. Cells are cut into blocks of bounded size on both sides, so a crowded one becomes many tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordering import top_per_group
from .sums import merge_sums, task_sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Centres at most, in number and in bytes; they go to every task.
MOST_CENTRES = 2048
CENTRE_BYTES = 16 << 20
#: Rows of the sample that the first centres are chosen from, for each centre.
SEED_ROWS = 32
ROUNDS = 4
#: Exact distances may be off by this much of themselves.
SLACK = 1e-9


def rounding(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """What `to_centres` may be off by: its squares are differences of larger numbers."""
    norms = np.sqrt((x * x).sum(axis=1))[:, None] + np.sqrt((centres * centres).sum(axis=1))[None]
    return np.sqrt((x.shape[1] + 4) * np.finfo(float).eps) * norms


def to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def spread_out(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    """`n` rows of the sample at most, each drawn with a weight of its squared distance to those before."""
    rng = np.random.default_rng(seed)
    picked = [0]
    far = np.square(sample - sample[0]).sum(axis=1)
    while len(picked) < n and far.max(initial=0) > 0:
        at = int(np.searchsorted(far.cumsum(), rng.random() * far.sum(), side="right").clip(0, len(sample) - 1))
        picked.append(at)
        far = np.minimum(far, np.square(sample - sample[at]).sum(axis=1))
    return sample[picked]


def fit_centres(df: DataFrame, n: int, rows: int, dim: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """About `n` centres of the vectors `vec`: seeds from a bounded hash sample, then rounds of means over all rows."""
    n = max(1, min(n, MOST_CENTRES, CENTRE_BYTES // (8 * dim)))
    share = max(1, rows // (SEED_ROWS * n))
    found = df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0).select("vec").orderBy(F.xxhash64("id")).limit(2 * SEED_ROWS * n).collect()
    if not found:
        found = df.select("vec").limit(n).collect()
    centres = spread_out(np.array(sorted(tuple(r["vec"]) for r in found), float), n, seed)
    for _ in range(rounds):
        now = centres

        def make(_, columns: list[np.ndarray], now: np.ndarray = now) -> dict:
            near = to_centres(columns[0], now).argmin(axis=1)
            return {(int(c),): np.concatenate([[(near == c).sum()], columns[0][near == c].sum(axis=0)]) for c in np.unique(near)}

        sums = merge_sums(task_sums(df, [], ["vec"], make, [T.StructField("cell", T.IntegerType())]), ["cell"]).collect()  # a row for each centre
        centres = now.copy()
        for r in sums:
            centres[r["cell"]] = np.array(r["sums"][1:]) / r["sums"][0]
    return centres


def with_cell(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vec, cell, gap): the nearest centre and the distance to it."""
    sent = df.sparkSession.sparkContext.broadcast(centres)  # at most CENTRE_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            far = to_centres(x, sent.value)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.square(x - sent.value[cell]).sum(axis=1)))], names=["id", "vec", "cell", "gap"])

    return df.select("id", "vec").mapInArrow(work, T.StructType([df.schema["id"], df.schema["vec"], T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]))


@dataclass
class Index:
    """Centres, and by cell the number of memory rows, the radius, and the blocks that its rows are cut into."""

    centres: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    rows: DataFrame
    per_block: int


def build(memory: DataFrame, n: int, rows: int, dim: int, per_block: int, rounds: int = ROUNDS, seed: int = 42) -> Index:
    """The cells of the vectors (id, vec)."""
    centres = fit_centres(memory, n, rows, dim, rounds, seed)
    placed = cut_lineage(with_cell(memory, centres))
    counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect():  # a row for each centre
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return Index(centres, counts, radius, placed, per_block)


def reach(far: np.ndarray, index: Index, k: int) -> np.ndarray:
    """A bound of the k-th distance from counts alone: the cells that lie whole within it hold k rows. `far`: distances to centres."""
    whole = np.where(index.counts > 0, far + index.radius, np.inf)
    order = np.argsort(whole, axis=1)
    enough = np.cumsum(index.counts[order], axis=1) >= k
    first = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
    bound = np.take_along_axis(whole, np.take_along_axis(order, first[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), bound, np.inf)


def _wanted(batches: Iterator[pa.RecordBatch], ours: Index, k: int, limit: str | None, first: int, last: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the cells that their rows meet, as a matrix, and the places of all cells."""
    step = max(1, (1 << 20) // len(ours.counts))
    for whole in batches:
        for i in range(0, whole.num_rows, step):
            b = whole.slice(i, step)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            far = to_centres(x, ours.centres)
            place = np.argsort(np.argsort(np.where(ours.counts > 0, far, np.inf), axis=1, kind="stable"), axis=1)
            want = (place >= first) & (place < last) & (ours.counts > 0)
            if limit is not None:
                off = rounding(x, ours.centres)
                given = b.column(2).to_numpy(zero_copy_only=False) * (1 + SLACK)
                most = np.minimum(np.where(np.isnan(given), np.inf, given), reach(far + off, ours, k))
                want &= far - ours.radius * (1 + SLACK) - off <= most[:, None]
            yield b, want, place


def visits(queries: DataFrame, index: Index, last: int) -> DataFrame:
    """(id, vec, cell, place) of the `last` cells nearest to a query, a row for each."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.counts, index.radius))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, want, place in _wanted(batches, Index(*sent.value, None, 0), 1, None, 0, last):
            rows, cells = np.nonzero(want)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cells.astype(np.int32)), pa.array(place[rows, cells].astype(np.int32))], names=["id", "vec", "cell", "place"])

    schema = T.StructType([queries.schema["id"], queries.schema["vec"], T.StructField("cell", T.IntegerType()), T.StructField("place", T.IntegerType())])
    return queries.select("id", "vec").mapInArrow(work, schema)


def blocks(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """By cell its first block and the number of its blocks: small cells share one, those above `per_block` rows are cut."""
    first, pieces = np.zeros(len(index.counts), np.int64), np.maximum(-(-index.counts // index.per_block), 1)
    block, room = -1, 0
    for c, (n, p) in enumerate(zip(index.counts.tolist(), pieces.tolist())):
        if n > room:
            first[c], block, room = block + 1, block + p, index.per_block - n if p == 1 else 0
        else:
            first[c], room = block, room - n
    return first, pieces


def calls(queries: DataFrame, index: Index, k: int, limit: str | None, first: int, last: int) -> DataFrame:
    """(id, vec, limit, block, cells): the blocks that hold cells which a query meets, from place `first` to `last` in the order
    of their centres' distance, so a vector is sent once to a block and not to each cell.

    With the column `limit`, only cells that may hold a row within it and within the bound by counts of the k-th distance.
    """
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.counts, index.radius, *blocks(index)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *ours, start, pieces = sent.value
        for b, want, _ in _wanted(batches, Index(*ours, None, 0), k, limit, first, last):
            rows, cells = np.nonzero(want)
            times = pieces[cells]
            rows, block, cells = np.repeat(rows, times), np.repeat(start[cells], times), np.repeat(cells, times)
            block = block + np.arange(len(block)) - np.repeat(times.cumsum() - times, times)
            by = np.lexsort((block, rows))
            rows, block, cells = rows[by], block[by], cells[by]
            new = np.nonzero(np.r_[True, (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])])[0] if len(rows) else np.zeros(0, int)
            at = pa.array(rows[new])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(rows)].astype(np.int32)), pa.array(cells.astype(np.int32)))
            square = b.column(2).take(at) if limit else pa.nulls(len(new), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), square, pa.array(block[new].astype(np.int32)), lists], names=["id", "vec", "limit", "block", "cells"])

    schema = T.StructType([queries.schema["id"], queries.schema["vec"], T.StructField("limit", T.DoubleType()), T.StructField("block", T.IntegerType()),
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return queries.select("id", "vec", *([limit] if limit else [])).mapInArrow(work, schema)


def _by_cell(values: np.ndarray, cell: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values.tolist()]), cell + 1)


def searched(wanted: DataFrame, index: Index, k: int, exclude_same: bool, schema: T.StructType) -> DataFrame:
    """The k best memory rows of every block that a query meets. Blocks hold `per_block` rows at most on either side, about."""
    from .neighbors import _meet_cells

    first, pieces = blocks(index)
    sizes = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / index.per_block).cast("int").alias("__qb"))
    q = wanted.join(sizes, "block").select(
        "block", F.pmod(F.xxhash64("id", "vec"), F.col("__qb")).cast("int").alias("__i"), F.col("id").alias("query_id"), F.col("vec").alias("query_vec"),
        (F.col("limit") * F.col("limit") * (1 + 4 * SLACK)).alias("limit"), "cells")
    cut = (_by_cell(first, F.col("cell")) + F.pmod(F.xxhash64("id", "vec"), _by_cell(pieces, F.col("cell")))).cast("int")
    m = index.rows.withColumn("block", cut).join(sizes, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("__qb") - 1)).alias("__i"), F.col("id").alias("memory_id"), F.col("vec").alias("memory_vec"), "cell")
    return _meet_cells(q, m, ["block", "__i"], k, exclude_same, schema)


def exact_join(q: DataFrame, m: DataFrame, nq: int, nm: int, dim: int, k: int, exclude_same: bool, block_bytes: int, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(best, work): the k best of every block that may hold one, and the numbers of pairs in all and multiplied.

    `q` has query_id and query_vec, `m` memory_id and memory_vec. Every query first meets the cell of its nearest centre; its
    k-th distance there, or the bound by counts, rules out cells whose nearest possible row is farther.
    """
    per_block = max(1, block_bytes // (8 * dim))
    memory = cut_lineage(m.select(F.col("memory_id").alias("id"), F.col("memory_vec").alias("vec")))
    index = build(memory, max(16, 4 * math.ceil(nm / per_block)), nm, dim, per_block)
    queries = cut_lineage(q.select(F.col("query_id").alias("id"), F.col("query_vec").alias("vec")))
    own = cut_lineage(calls(queries, index, k, None, 0, 1))
    first = cut_lineage(searched(own, index, k, exclude_same, schema))
    kth = top_per_group(first, ["query_id"], [F.col("__score"), F.col("memory_id")], k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("__score"))).alias("limit"))
    limited = queries.join(kth.withColumnRenamed("query_id", "id"), "id", "left")
    rest = cut_lineage(calls(limited, index, k + int(exclude_same), "limit", 1, len(index.centres)))
    best = first.unionByName(searched(rest, index, k, exclude_same, schema))
    _, pieces = blocks(index)
    met = F.aggregate("cells", F.lit(0.0), lambda n, c: n + _by_cell(index.counts / pieces, c))
    work = own.unionByName(rest).agg(F.round(F.sum(met)).cast("long").alias("pairs_multiplied")).select(F.lit(nq * nm).cast("long").alias("pairs"), "pairs_multiplied")
    return best, work


def probes_for(curve: list[float], recall: float) -> int:
    """The smallest number of cells whose measured recall reaches the wanted one."""
    return next((i + 1 for i, r in enumerate(curve) if r >= recall), len(curve))


def recall_curve(sample: DataFrame, truth: DataFrame, index: Index) -> list[float]:
    """By number of cells searched, the share of true neighbours of the sample that lie in them.

    `truth` has query_id and memory_id; only counts by place reach the driver.
    """
    order = visits(sample, index, len(index.centres)).select(F.col("id").alias("query_id"), "cell", "place")
    home = truth.join(index.rows.select(F.col("id").alias("memory_id"), "cell"), "memory_id").join(order, ["query_id", "cell"])
    places = home.groupBy("query_id", "memory_id").agg(F.min("place").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    counts = dict(map(tuple, places.collect()))  # a row for each centre at most
    total, seen, curve = sum(counts.values()), 0, []
    for i in range(len(index.centres)):
        seen += counts.get(i, 0)
        curve.append(seen / total if total else 1.0)
    return curve
