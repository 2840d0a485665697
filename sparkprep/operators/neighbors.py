"""Nearest-neighbour joins over vector columns.

A pair table is never built. Each task multiplies a block of query vectors with a block of memory
vectors and passes on only the k best per query, so the shuffle carries k rows per query and task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..session import cut_lineage
from . import cells
from .ordering import hash_rank, top_per_group
from .sums import vector_sums

BROADCAST_BYTES = 64 << 20
_CELLS = 1 << 20  # entries of one distance block
LEAF, GROUP = 256, 128  # rows of a leaf of the memory, and queries that meet it together
TASK_PAIRS = 500_000_000  # pairs of a task, about
GATHERED = 1 << 16  # rows that a task searches at once, about
PARTS = 1024  # of space that queries are dealt by
RECALL_QUERIES = 500  # that the number of probes is measured on, about
METRICS = ("l2", "ip", "cosine")
_ZERO_NORM = vx.ZERO_NORM

# Tasks get the kernel functions of this module by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- block kernel -------------------------------------------------------------------------------

def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_pylist())


def _score(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance (l2) or negated similarity of vector pairs; smaller is closer."""
    if metric == "l2":
        return ((q - m) ** 2).sum(axis=1)
    dot = (q * m).sum(axis=1)
    if metric == "ip":
        return -dot
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((m * m).sum(axis=1))
    return -np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def _cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Row-wise cosine in [0, 1]; 0 for a zero vector."""
    a, b = np.sqrt((q * q).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
    ok = (a >= _ZERO_NORM) & (b >= _ZERO_NORM)
    raw = np.divide((q * m).sum(axis=1), a * b, out=np.zeros(len(q)), where=ok)
    return np.clip(raw, 0.0, 1.0)


def _best(qpos: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores per query, ties by smaller id."""
    order = np.lexsort((ids, score, qpos))
    groups = qpos[order]
    start = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(groups)), 0))
    return order[np.arange(len(groups)) - first < k]


@dataclass
class Tree:
    """Rows in an order in which neighbours lie close, cut into leaves with their bounding boxes.

    Every split halves a node at the median of its widest dimension, so `axis` and `cut` of node i are followed by nodes
    2i+1 and 2i+2, and the leaves of a tree are `starts[i]` to `starts[i + 1]` of `order`.
    """

    order: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: np.ndarray
    cut: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf in whose part of space each row lies."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def _tree(x: np.ndarray, size: int) -> Tree:
    """A tree with leaves of `size` rows at most over the rows of `x` that are finite."""
    order = np.nonzero(np.isfinite(x).all(axis=1))[0]
    levels = max(0, math.ceil(math.log2(max(1, len(order) / size))))
    starts, axis, cut = np.array([0, len(order)]), [], []
    for _ in range(levels):
        marks = [0]
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part, mid = x[order[lo:hi]], (hi - lo) // 2
            a = int((part.max(axis=0) - part.min(axis=0)).argmax()) if hi > lo else 0
            near = np.argpartition(part[:, a], max(mid - 1, 0)) if hi > lo else np.zeros(0, int)
            order[lo:hi] = order[lo:hi][near]
            axis.append(a)
            cut.append(float(part[near[max(mid - 1, 0)], a]) if hi > lo else 0.0)
            marks += [lo + mid, hi]
        starts = np.array(marks)
    low, high = np.full((len(starts) - 1, x.shape[1]), np.inf), np.full((len(starts) - 1, x.shape[1]), -np.inf)
    for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if hi > lo:
            low[i], high[i] = x[order[lo:hi]].min(axis=0), x[order[lo:hi]].max(axis=0)
    return Tree(order, starts, low, high, np.array(axis, np.int64), np.array(cut))


def _least(low: np.ndarray, high: np.ndarray, tree: Tree, metric: str) -> np.ndarray:
    """For each leaf, no score between a row in the box and one of the leaf is below this."""
    if metric == "l2":
        gap = np.maximum(np.maximum(tree.low - high, low - tree.high), 0)
        return (gap * gap).sum(axis=1)
    ends = [q * m for q in (low, high) for m in (tree.low, tree.high)]
    return -np.maximum(np.maximum(ends[0], ends[1]), np.maximum(ends[2], ends[3])).sum(axis=1)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Memory:
    """Memory rows as the kernel reads them: in tree order, with a column more that turns a product into a score."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, metric: str, exclude_same: bool) -> None:
        seen = _unit_rows(rows) if metric == "cosine" else rows
        self.tree = _tree(seen, LEAF)
        order = self.tree.order
        self.ids, self.rows, self.metric = ids[order], rows[order], metric
        seen = seen[order]
        self.norm = float(np.sqrt((seen * seen).sum(axis=1)).max(initial=0.0))
        # Products of long vectors are made in single precision; what passes is scored again in double.
        self.kind = np.float32 if rows.shape[1] >= 16 and self.norm < 1e15 else np.float64
        more = (seen * seen).sum(axis=1) if metric == "l2" else np.zeros(len(seen))
        self.right = np.column_stack([seen, more]).astype(self.kind)
        self.at = {}
        if exclude_same:
            last = {v: i for i, v in enumerate(ids.tolist())}
            place = np.full(len(ids), -1)
            place[order] = np.arange(len(order))
            self.at = {v: int(place[i]) for v, i in last.items()}


def _block_top_k(qids, q, mids, m, k: int, metric: str, exclude_same: bool, memory: Memory | None = None, within: np.ndarray | None = None, sorted_: bool = False):
    """(query positions, memory ids, scores, cosines) of the k closest memory rows of this block.

    Queries that lie close meet the leaves of the memory together, nearest first, until no leaf can hold a row as near as
    their k-th one. `within`: a score by query that rows of interest do not exceed, infinite where none is known.
    `sorted_`: the queries are finite and lie close in their order already.
    """
    memory = memory or Memory(mids, m, metric, exclude_same)
    tree, n = memory.tree, len(memory.ids)
    none = np.zeros(0, int), memory.ids[:0], np.zeros(0), np.zeros(0)
    if not n or not len(q) or not k:
        return none
    seen = _unit_rows(q) if metric == "cosine" else q
    size = GROUP if memory.kind is np.float64 else 4 * GROUP
    if sorted_:
        groups = [np.arange(i, min(i + size, len(q))) for i in range(0, len(q), size)]
    else:
        cuts = _tree(seen, size)
        groups = [cuts.order[i:j] for i, j in zip(cuts.starts[:-1], cuts.starts[1:]) if j > i]
    known = np.full(len(q), np.inf) if within is None else np.where(np.isnan(within), np.inf, within)
    eps = float(np.finfo(memory.kind).eps)
    out = []
    for at in groups:
        part, exact, limit = seen[at], q[at], known[at]
        base = (part * part).sum(axis=1) if metric == "l2" else np.zeros(len(at))
        wide = np.sqrt((part * part).sum(axis=1)) + memory.norm
        kind = memory.kind if wide.max() < 1e15 else np.float64
        off = 4 * (q.shape[1] + 8) * eps * wide * wide
        left = np.column_stack([(-2 if metric == "l2" else -1) * part, np.ones(len(at))]).astype(kind)
        own = np.array([memory.at.get(v, -1) for v in qids[at].tolist()]) if memory.at else None
        need = k + (own is not None)
        least = _least(part.min(axis=0), part.max(axis=0), tree, metric)
        todo = np.argsort(least, kind="stable")
        bound = least[todo] - off.max()
        sizes = np.diff(tree.starts)[todo].cumsum()
        done, step = 0, 4 * LEAF
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        while done < len(todo):
            stop = min(int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + step)) + 1, len(todo))
            stop = min(stop, int(np.searchsorted(bound, (limit + off).max(), side="right")))
            if stop <= done:
                break
            leaves = np.sort(todo[done:stop])
            place = np.concatenate([np.arange(tree.starts[i], tree.starts[i + 1]) for i in leaves])
            done, step = stop, min(2 * step, max(LEAF, _CELLS // len(at)))
            if not len(place):
                continue
            rough = left @ memory.right[place].T
            most = limit - base + off
            if len(place) >= need:
                open_ = np.isinf(limit)
                if open_.any():
                    most[open_] = np.partition(rough[open_], need - 1, axis=1)[:, need - 1] + 2 * off[open_]
            if rough.dtype == np.float32:
                most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
            near = np.flatnonzero(rough <= most[:, None])
            rows, cols = near // len(place), place[near % len(place)]
            if own is not None:
                other = own[rows] != cols
                rows, cols = rows[other], cols[other]
            # Scores of the few candidates again, pair by pair, so equal vectors tie exactly.
            score = _score(exact[rows], memory.rows[cols], metric)
            fit = np.isfinite(score) & (score <= limit[rows])
            if not fit.any():
                continue
            rows, cols, score = (np.concatenate([x, y[fit]]) for x, y in zip(best, (rows, cols, score)))
            keep = _best(rows, memory.ids[cols], score, k)
            best = rows[keep], cols[keep], score[keep]
            full = np.bincount(best[0], minlength=len(at)) >= k
            kth = np.full(len(at), -np.inf)
            np.maximum.at(kth, best[0], best[2])
            limit = np.where(full, np.minimum(kth, limit), limit)
        rows, cols, score = best
        if len(rows):
            out.append((at[rows], memory.ids[cols], score, _cosine(exact[rows], memory.rows[cols])))
    if not out:
        return none
    return tuple(np.concatenate(x) for x in zip(*out))


def _result(qids, qpos, ids, score, cosine, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        pa.array(qids[qpos].tolist(), schema.field(0).type),
        pa.array(ids.tolist(), schema.field(1).type),
        pa.array(score, pa.float64()),
        pa.array(cosine, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# ---- exact join ---------------------------------------------------------------------------------

def _side(df: DataFrame, id_col: str, vec: str, prefix: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(
        F.col(id_col).alias(f"{prefix}_id"), F.col(vec).cast("array<double>").alias(f"{prefix}_vec"))


def _size(df: DataFrame, vec: str) -> tuple[int, int]:
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if n and lo != hi:
        raise ValueError(f"vectors differ in length: {lo} to {hi}")
    return n, hi or 0


def knn_join(
    queries: DataFrame,
    memory: DataFrame,
    k: int,
    *,
    query_id: str,
    memory_id: str,
    vec: str = "embedding",
    metric: str = "l2",
    exclude_same: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k nearest memory rows of every query: (query_id, memory_id, distance, similarity, rank).

    `distance` is the squared L2 distance, or the inner product / cosine itself; `similarity` is the
    cosine in [0, 1]; ties go to the smaller memory id. Exact at any size: a side whose measured size fits `broadcast_bytes` is sent
    to the other. Otherwise the memory is cut into cells, and a query meets only cells that can hold a row as near as its
    k-th one so far (l2); or both sides are cut into hash blocks that meet pairwise (other metrics). The inputs are read
    more than once (size, vectors), so store computed ones first.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q, m, nq, nm, dim = _sides(queries, memory, query_id, memory_id, vec)
    qbytes, mbytes, schema = nq * dim * 8, nm * dim * 8, _found_schema(q, m)
    args = (k, metric, exclude_same, schema)
    if mbytes <= broadcast_bytes:
        best = _against_memory(q, m, nq, *args)
    elif qbytes <= broadcast_bytes:
        best = _against_queries(q, m, *args)
    elif metric == "l2":
        best, _ = cells.exact_join(q, m, nq, nm, dim, k, exclude_same, broadcast_bytes, schema)
    else:
        best = _blocks(q, m, math.ceil(qbytes / broadcast_bytes), math.ceil(mbytes / broadcast_bytes), *args)
    return _ranked(best, k, metric)


def _sides(queries: DataFrame, memory: DataFrame, query_id: str, memory_id: str, vec: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    q, m = _side(queries, query_id, vec, "query"), _side(memory, memory_id, vec, "memory")
    nm, dm = _size(m, "memory_vec")
    nq, dq = (nm, dm) if queries is memory else _size(q, "query_vec")
    if nq and nm and dq != dm:
        raise ValueError(f"query vectors have {dq} elements, memory vectors {dm}")
    return q, m, nq, nm, max(dq, dm)


def _found_schema(q: DataFrame, m: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", q.schema["query_id"].dataType),
        T.StructField("memory_id", m.schema["memory_id"].dataType),
        T.StructField("__score", T.DoubleType()),
        T.StructField("similarity", T.DoubleType()),
    ])


def _ranked(best: DataFrame, k: int, metric: str) -> DataFrame:
    ranked = top_per_group(best, ["query_id"], [F.col("__score"), F.col("memory_id")], k)
    score = F.col("__score")
    return ranked.select(
        "query_id", "memory_id", (score if metric == "l2" else -score).alias("distance"), "similarity", "rank")


def knn_work(
    queries: DataFrame, memory: DataFrame, k: int, *, query_id: str, memory_id: str, vec: str = "embedding", exclude_same: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(pairs, pairs_multiplied): all pairs of two large sides, and those that the cells of `knn_join` leave to be multiplied."""
    q, m, nq, nm, dim = _sides(queries, memory, query_id, memory_id, vec)
    return cells.exact_join(q, m, nq, nm, dim, k, exclude_same, broadcast_bytes, _found_schema(q, m))[1]


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have GATHERED rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= GATHERED:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _near_together(q: DataFrame, tree: Tree, tasks: int) -> DataFrame:
    """The queries dealt to tasks by the part of space that they lie in, so that those of a task meet few leaves."""
    shared = q.sparkSession.sparkContext.broadcast(tree)  # at most PARTS splits
    schema = T.StructType([*q.schema.fields, T.StructField("__leaf", T.IntegerType())])
    arrow = _arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.leaf_of(_matrix(b["query_vec"])) if len(shared.value.axis) else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b["query_id"], b["query_vec"], pa.array(leaf.astype(np.int32))], schema=arrow)

    return q.mapInArrow(place, schema).repartitionByRange(tasks, "__leaf", F.xxhash64("query_id")).select("query_id", "query_vec")


def _against_memory(q, m, nq, k, metric, exclude_same, schema):
    """Memory is small: one pass over the queries, no merge needed."""
    small = m.toArrow()
    mids, mat = _ids(small["memory_id"]), _matrix(small["memory_vec"])
    shared = q.sparkSession.sparkContext.broadcast((mids, mat))
    arrow = _arrow_schema(schema)
    tasks = min(math.ceil(nq * len(mids) / TASK_PAIRS), math.ceil(nq / GROUP))
    if tasks > 1:
        cuts = _tree(mat, max(LEAF, math.ceil(len(mids) / PARTS)))
        q = _near_together(q, replace(cuts, order=cuts.order[:0]), tasks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mids, mat = shared.value
        memory = None
        for b in _gathered(batches) if len(mids) else ():
            memory = memory or Memory(mids, mat, metric, exclude_same)
            qids = _ids(b["query_id"])
            yield _result(qids, *_block_top_k(qids, _matrix(b["query_vec"]), mids, mat, k, metric, exclude_same, memory), arrow)

    return q.mapInArrow(search, schema)


def _against_queries(q, m, k, metric, exclude_same, schema):
    """Queries are few: memory is scanned where it lies; a task keeps its k best per query."""
    small = q.toArrow()
    shared = q.sparkSession.sparkContext.broadcast((_ids(small["query_id"]), _matrix(small["query_vec"])))
    arrow = _arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, mat = shared.value
        best = _Best(len(qids), k)
        for b in _gathered(batches) if len(qids) else ():
            best.add(_block_top_k(qids, mat, _ids(b["memory_id"]), _matrix(b["memory_vec"]), k, metric, exclude_same, within=best.limit))
            best.reduce()
        if best.found:
            yield _result(qids, *best.found[0], arrow)

    return m.mapInArrow(search, schema)


class _Best:
    """What was found for each query so far, reduced to the k best of each; `limit` is the k-th score or infinite."""

    def __init__(self, queries: int, k: int, limit: np.ndarray | None = None) -> None:
        self.k, self.found, self.n = k, [], 0
        self.limit = np.full(queries, np.inf) if limit is None else np.where(np.isnan(limit), np.inf, limit)

    def add(self, found: tuple) -> None:
        if len(found[0]):
            self.found.append(found)
            self.n += len(found[0])

    def reduce(self) -> None:
        if not self.found:
            return
        rows, ids, score, cosine = (np.concatenate(x) for x in zip(*self.found))
        keep = _best(rows, ids, score, self.k)
        self.found, self.n = [(rows[keep], ids[keep], score[keep], cosine[keep])], 0
        kth = np.full(len(self.limit), -np.inf)
        np.maximum.at(kth, rows[keep], score[keep])
        full = np.bincount(rows[keep], minlength=len(self.limit)) >= self.k
        self.limit = np.where(full, np.minimum(kth, self.limit), self.limit)


def _meet(q, m, keys, k, metric, exclude_same, schema):
    """k best per query inside every pair of blocks that share the keys."""
    arrow = _arrow_schema(schema)

    def search(qt: pa.Table, mt: pa.Table) -> pa.Table:
        qids = _ids(qt["query_id"])
        if not len(qids) or not mt.num_rows:
            return arrow.empty_table()
        found = _block_top_k(qids, _matrix(qt["query_vec"]), _ids(mt["memory_id"]), _matrix(mt["memory_vec"]), k, metric, exclude_same)
        return pa.Table.from_batches([_result(qids, *found, arrow)])

    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(search, schema)


def _meet_cells(q, m, keys, k, exclude_same, schema):
    """As `_meet`, where a query of a block meets only its cells, the list `cells`, and `limit` bounds its k-th distance."""
    arrow = _arrow_schema(schema)

    def search(qt: pa.Table, mt: pa.Table) -> pa.Table:
        qids = _ids(qt["query_id"])
        if not len(qids) or not mt.num_rows:
            return arrow.empty_table()
        mat = _matrix(qt["query_vec"])
        order = _tree(mat, GROUP).order
        place = np.full(len(qids), -1)
        place[order] = np.arange(len(order))
        qids, mat = qids[order], mat[order]
        listed = qt["cells"].combine_chunks()
        rows, wanted = place[np.repeat(np.arange(len(place)), listed.value_lengths().to_numpy(zero_copy_only=False))], listed.flatten().to_numpy(zero_copy_only=False)
        wanted, rows = wanted[rows >= 0], rows[rows >= 0]
        by_cell = np.lexsort((rows, wanted))
        wanted, rows = wanted[by_cell], rows[by_cell]
        mids, there, mcell = _ids(mt["memory_id"]), _matrix(mt["memory_vec"]), mt["cell"].to_numpy()
        best = _Best(len(qids), k, qt["limit"].to_numpy()[order])
        for c in np.unique(mcell):
            ask, here = rows[np.searchsorted(wanted, c, "left"):np.searchsorted(wanted, c, "right")], np.nonzero(mcell == c)[0]
            found = _block_top_k(qids[ask], mat[ask], mids[here], there[here], k, "l2", exclude_same, within=best.limit[ask], sorted_=True)
            best.add((ask[found[0]], *found[1:]))
            if best.n > 2 * k * len(qids):
                best.reduce()
        best.reduce()
        return pa.Table.from_batches([_result(qids, *best.found[0], arrow)]) if best.found else arrow.empty_table()

    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(search, schema)


def _blocks(q, m, nq, nm, k, metric, exclude_same, schema):
    """Both sides are large: query block i meets memory block j in a task of its own."""
    def block(col: str, n: int) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qb = q.withColumn("__i", block("query_id", nq)).withColumn("__j", every(nm))
    mb = m.withColumn("__j", block("memory_id", nm)).withColumn("__i", every(nq))
    return _meet(qb, mb, ["__i", "__j"], k, metric, exclude_same, schema)


# ---- approximate join ---------------------------------------------------------------------------

def knn_join_cells(
    queries: DataFrame,
    memory: DataFrame,
    k: int,
    *,
    query_id: str,
    memory_id: str,
    vec: str = "embedding",
    n_cells: int | None = None,
    probes: int | None = None,
    recall: float = 0.95,
    seed: int = 42,
    block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Approximate L2 join for two large sides: only the nearest `probes` cells of a query are searched.

    Cells (about the square root of the memory's rows) are fitted by k-means over all rows and cut into blocks of bounded
    size on both sides. Without `probes`, their number is the smallest one that finds `recall` of the true neighbours of about
    RECALL_QUERIES queries, chosen by hash. Distances are exact; neighbours in other cells are missed. `knn_join` is
    the exact form.
    """
    q, m, nq, nm, dim = _sides(queries, memory, query_id, memory_id, vec)
    schema = _found_schema(q, m)
    if not nq or not nm:
        return _ranked(q.sparkSession.createDataFrame([], schema), k, "l2")
    stored = cut_lineage(m.select(F.col("memory_id").alias("id"), F.col("memory_vec").alias("vec")))
    index = cells.build(stored, n_cells or max(8, math.isqrt(nm)), nm, dim, max(1, block_bytes // (8 * dim)), seed=seed)
    asked = cut_lineage(q.select(F.col("query_id").alias("id"), F.col("query_vec").alias("vec")))
    if probes is None:
        some = cut_lineage(asked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, nq // RECALL_QUERIES))) == 0))
        truth = knn_join(some, stored, k, query_id="id", memory_id="id", vec="vec")
        # Chance of the sample: ask for a little more than is wanted.
        probes = cells.probes_for(cells.recall_curve(some, truth, index), min(1.0, recall + (1 - recall) / 2))
    wanted = cut_lineage(cells.calls(asked, index, k, None, 0, probes))
    return _ranked(cells.searched(wanted, index, k, False, schema), k, "l2")


# ---- around the neighbours ----------------------------------------------------------------------

def with_records(neighbors: DataFrame, memory: DataFrame, memory_id: str, vec: str = "embedding") -> DataFrame:
    """Attach the memory record of each neighbour. The vectors stay behind: the similarity is there already."""
    return neighbors.join(memory.drop(vec).withColumnRenamed(memory_id, "memory_id"), "memory_id")


def pair_spread(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Number of unordered pairs inside each group and the sum of their squared distances.

    Uses sum over i<j of |xi-xj|^2 = n*sum|x|^2 - |sum x|^2, so no pair is ever formed.
    """
    named = df.select(by, F.col(vec).cast("array<double>").alias("__vec")).where(F.size("__vec") > 0)
    cell = F.transform(F.arrays_zip("counts", "sums", "squares"), lambda e: e["counts"] * e["squares"] - e["sums"] * e["sums"])
    total = vector_sums(named, [by], "__vec").select(
        by, F.array_max("counts").alias("n"), F.aggregate(cell, F.lit(0.0), lambda a, b: a + b).alias("sum_sq_distance"))
    return total.select(by, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
                        F.greatest("sum_sq_distance", F.lit(0.0)).alias("sum_sq_distance"))


def mean_cosine_to_others(df: DataFrame, id_col: str, vec: str = "embedding") -> DataFrame:
    """Mean unclipped cosine of every record to all other records, from one sum vector.

    The sum of cosines to all others is u.S - u.u with u the unit vector and S the sum of all units.
    """
    units = df.select(id_col, vx.unit(F.col(vec)).alias("__u"))
    total = vector_sums(units, [], "__u").select("sums").scalar()
    n = df.agg(F.count(F.lit(1))).scalar()
    u = F.col("__u")
    return units.withColumn("__s", total).select(
        id_col,
        F.try_divide(vx.inner_product(u, F.col("__s")) - vx.inner_product(u, u), n - 1).alias("mean_cosine"))


def negative_pairs(
    df: DataFrame, id_col: str, family: str, n_pairs: int, seed: int = 42, vec: str = "embedding"
) -> DataFrame:
    """`n_pairs` seeded random pairs of records from two different families.

    Members are numbered inside their family; each pair picks two families and a number in each by
    hash, and two equi-joins fetch the records.
    """
    rows = df.groupBy(family).agg(F.count(F.lit(1)).alias("n")).where(F.col(family).isNotNull()).orderBy(family).limit(10_001).collect()
    if not 2 <= len(rows) <= 10_000:
        raise ValueError(f"need 2 to 10000 families, got {len(rows)}")
    names = F.array(*[F.lit(r[0]) for r in rows])
    sizes = F.array(*[F.lit(r[1]) for r in rows])
    members = hash_rank(df.select(id_col, family, vec), [family], [id_col], seed, "__pos")

    def draw(i: int, n: Column) -> Column:
        return F.pmod(F.xxhash64("pair", F.lit(seed), F.lit(i)), n.cast("long"))

    count = F.lit(len(rows))
    pairs = df.sparkSession.range(n_pairs).withColumnRenamed("id", "pair")
    pairs = pairs.withColumn("fa", draw(1, count))
    pairs = pairs.withColumn("fb", (F.col("fa") + 1 + draw(2, count - 1)) % count)
    for side, i in (("a", 3), ("b", 4)):
        at = (F.col(f"f{side}") + 1).cast("int")
        pairs = pairs.withColumn(f"{side}_family", F.element_at(names, at)).withColumn(
            f"{side}_pos", draw(i, F.element_at(sizes, at)) + 1)
    for side in ("a", "b"):
        found = members.select(
            F.col(family).alias(f"{side}_family"), F.col("__pos").alias(f"{side}_pos"),
            F.col(id_col).alias(f"{side}_id"), F.col(vec).alias(f"{side}_vec"))
        pairs = pairs.join(found, [f"{side}_family", f"{side}_pos"])
    return pairs.select("pair", "a_id", "a_family", "a_vec", "b_id", "b_family", "b_vec")


def contrastive_loss(positives: DataFrame, negatives: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean contrastive loss over all same-family pairs and the given cross-family pairs.

    `positives` is the result of `pair_spread`: their part of the loss is linear in squared distances.
    """
    pos = positives.agg(F.struct(F.sum("pairs").alias("n"), F.sum("sum_sq_distance").alias("s"))).scalar()
    gap = F.greatest(F.lit(0.0), F.lit(margin) - F.sqrt(vx.squared_l2(F.col("a_vec"), F.col("b_vec"))))
    neg = negatives.agg(F.count(F.lit(1)).alias("n_negative"), F.coalesce(F.sum(gap * gap), F.lit(0.0)).alias("neg_loss"))
    return neg.withColumn("__pos", pos).select(
        F.col("__pos.n").alias("n_positive"), "n_negative",
        F.try_divide(F.col("__pos.s") + F.col("neg_loss"), F.col("__pos.n") + F.col("n_negative")).alias("loss"))
