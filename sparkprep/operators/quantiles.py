"""Exact quantiles that stay bounded in memory."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import null_safe_join, running_sums

# Columns with at most this many values are aggregated directly.
EXACT_ROWS = 20_000
# Values of one region that may be sorted in one aggregation buffer.
BRACKET_ROWS = 100_000
_ACCURACY = 10_000
_MARGIN = 2.5 / _ACCURACY
_SPLITS = 128
_COLUMNS = 20


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact_rows: int = EXACT_ROWS, bracket_rows: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, NULLs left out, as plain numbers.

    One pass finds approximate quantiles around every wanted rank of every column. They cut each
    column into regions, a second pass counts the rows per region, and a third reads the ranks from
    the few rows of their regions. Regions that are still large are cut again, so the answer is exact
    at any size while no buffer holds more than `bracket_rows` values. Every cut value is a region of
    its own, so copies never keep a region large. Only counts and single values reach the driver.
    """
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(cols), _COLUMNS):
        out.update(_quantiles(df, list(cols)[start:start + _COLUMNS], list(probs), exact_rows, bracket_rows))
    return out


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], exact_rows: int, bracket_rows: int) -> dict:
    around = sorted({min(1.0, max(0.0, p + m)) for p in probs for m in (-_MARGIN, _MARGIN)})
    x = lambda c: F.col(c).cast("double")
    df = df.select(*[F.when(~F.isnan(x(c)), x(c)).alias(c) for c in cols])
    first = df.agg(
        *[F.count(c).alias(f"{c}__n") for c in cols], *[F.percentile_approx(x(c), around, _ACCURACY).alias(f"{c}__a") for c in cols]
    ).first()
    counts = {c: first[f"{c}__n"] for c in cols}
    small = [c for c in cols if counts[c] <= exact_rows]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[F.expr(f"percentile(`{c}`, array({','.join(map(repr, probs))}))").alias(c) for c in small]
        ).first()
        out.update({c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in small})
    large = [c for c in cols if c not in out]
    if large:
        position = {c: [p * (counts[c] - 1) for p in probs] for c in large}
        ranks = {c: {r for v in position[c] for r in (math.floor(v), min(math.floor(v) + 1, counts[c] - 1))} for c in large}
        values = _order_statistics(df, {c: first[f"{c}__a"] for c in large}, ranks, bracket_rows)
        for c in large:
            out[c] = []
            for v in position[c]:
                low = values[c, math.floor(v)]
                high = values[c, min(math.floor(v) + 1, counts[c] - 1)]
                out[c].append(low + (high - low) * (v - math.floor(v)))
    return {c: out[c] for c in cols}


def _order_statistics(df: DataFrame, cuts: dict[str, list[float]], ranks: dict[str, set[int]], bracket_rows: int) -> dict:
    """Values at 0-based ranks of several columns, {(column, rank): value}."""
    ends = {c: isolated(v) for c, v in cuts.items()}
    while True:
        regions = _count_regions(df, ends)
        values: dict[tuple[str, int], float] = {}
        open_: dict[tuple[str, int], list[tuple[int, int]]] = {}
        split: dict[tuple[str, int], list[float]] = {}
        for c, wanted in ranks.items():
            below, todo = 0, sorted(wanted)
            for region, n, lo, hi in regions[c]:
                while todo and todo[0] < below + n:
                    rank = todo.pop(0)
                    if lo == hi:
                        values[c, rank] = lo
                    else:
                        open_.setdefault((c, region), []).append((rank, rank - below + 1))
                        if n > bracket_rows:
                            split.setdefault((c, region), []).append((rank - below) / (n - 1))
                below += n
        if not split:
            return {**values, **_pick(df, ends, open_)}
        for c, more in _split_regions(df, ends, split).items():
            ends[c] = isolated([*ends[c], *more])


def isolated(values: Sequence[float]) -> list[float]:
    """Region ends such that every given value is alone in its region."""
    return sorted({e for v in values for e in (math.nextafter(v, -math.inf), v)})


def _in_regions(df: DataFrame, ends: dict[str, list[float]], only: Iterable[tuple[str, int]]) -> DataFrame:
    """(column, region, x) of the values in the listed (column, region) pairs, in one pass of Arrow batches.

    Region r holds the values above end r - 1, up to and with end r.
    """
    kept: dict[str, list[int]] = {}
    for c, r in only:
        kept.setdefault(c, []).append(r)
    cuts = {c: np.array(ends[c]) for c in kept}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (c, cut) in enumerate(cuts.items()):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                region = np.searchsorted(cut, x)
                hit = np.isin(region, kept[c]) & ~np.isnan(x)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c] * int(hit.sum())), pa.array(region[hit].astype(np.int32)), pa.array(x[hit])], names=["column", "region", "x"])

    return df.select(*[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(cuts)]).mapInArrow(work, "column string, region int, x double")


def _count_regions(df: DataFrame, ends: dict[str, list[float]]) -> dict[str, list[tuple]]:
    """Per column (region, rows, smallest, largest), counted in the tasks: no row leaves them."""
    cuts = {c: np.array(cut) for c, cut in ends.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(cut) + 1, np.int64) for cut in cuts.values()]
        lo = [np.full(len(cut) + 1, np.inf) for cut in cuts.values()]
        hi = [np.full(len(cut) + 1, -np.inf) for cut in cuts.values()]
        for batch in batches:
            for i, cut in enumerate(cuts.values()):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                region = np.searchsorted(cut, x)
                n[i] += np.bincount(region, minlength=len(cut) + 1)
                np.minimum.at(lo[i], region, x)
                np.maximum.at(hi[i], region, x)
        for i, c in enumerate(cuts):
            at = np.nonzero(n[i])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[i][at]), pa.array(lo[i][at]), pa.array(hi[i][at])], names=["column", "region", "n", "lo", "hi"])

    counted = df.select(*[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(cuts)]).mapInArrow(work, "column string, region int, n long, lo double, hi double")
    rows = counted.groupBy("column", "region").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out: dict[str, list[tuple]] = {c: [] for c in ends}
    for r in rows:
        out[r["column"]].append((r["region"], r["n"], r["lo"], r["hi"]))
    return {c: sorted(v) for c, v in out.items()}


def _split_regions(df: DataFrame, ends: dict[str, list[float]], split: dict[tuple[str, int], list[float]]) -> dict[str, list[float]]:
    """New cut values inside large regions: the points of a quantile grid next to the wanted shares.

    Only those few are kept, so the range expression of a column stays small however often it is cut.
    """
    grid = [i / _SPLITS for i in range(_SPLITS + 1)]
    rows = _in_regions(df, ends, split).groupBy("column", "region").agg(
        F.percentile_approx("x", grid, _ACCURACY).alias("a")).collect()
    out: dict[str, list[float]] = {}
    for r in rows:
        near = {int(s * _SPLITS) + i for s in split[r["column"], r["region"]] for i in (-1, 0, 1, 2)}
        out.setdefault(r["column"], []).extend(r["a"][i] for i in near if 0 <= i <= _SPLITS)
    return out


def _pick(df: DataFrame, ends: dict[str, list[float]], wanted: dict) -> dict:
    """Read the open ranks from the sorted values of their regions; only the asked values are returned."""
    if not wanted:
        return {}
    places = F.create_map(*[v for (c, r), at in wanted.items() for v in (F.lit(f"{r} {c}"), F.array(*[F.lit(k) for _, k in at]))])
    key = F.concat_ws(" ", F.col("region").cast("string"), "column")
    rows = (
        _in_regions(df, ends, wanted).groupBy("column", "region").agg(F.sort_array(F.collect_list("x")).alias("v"))
        .select("column", "region", F.transform(F.element_at(places, key), lambda k: F.element_at("v", k)).alias("picked")).collect()
    )
    return {(r["column"], rank): value for r in rows for (rank, _), value in zip(wanted[r["column"], r["region"]], r["picked"])}


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact quantiles of columns per group, as one row per group and column.

    Works on distinct values with their counts, so copies are combined before the shuffle, and on
    running counts cut into value ranges, so no group has to fit into one task. All columns share
    the passes.
    """
    by = [*by, "column"]
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("__x")) for c in cols]
    long = df.select(*by[:-1], F.explode(F.array(*entries)).alias("e")).select(*by[:-1], "e.*").where(F.col("__x").isNotNull())
    counted = long.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))
    seen = running_sums(counted, by, "__x", {"__seen": "__c"}, spread=long)
    totals = long.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    joined = null_safe_join(seen, totals, by, "inner")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("__seen") > rank, F.col("__x")))

    aggs = []
    for p, name in zip(probs, names):
        position = F.lit(float(p)) * (F.col("__n") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("__n") - 1)
        aggs += [
            at(low).alias(f"__lo_{name}"),
            at(high).alias(f"__hi_{name}"),
            F.max(position - low).alias(f"__f_{name}"),
        ]
    picked = joined.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in names
        ],
    )


def quantile_bin(value: Column, cuts: Sequence[float | None]) -> Column:
    """How many different cut points lie below the value; -1 for NULL."""
    x = value.cast("double")
    above = sum((F.when(x > q, 1).otherwise(0) for q in sorted({q for q in cuts if q is not None})), F.lit(0))
    return F.when(x.isNull(), F.lit(-1)).otherwise(above)
