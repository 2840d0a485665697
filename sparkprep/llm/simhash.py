"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in Arrow batches, sorted into tiles by population count, and tiles are compared with numpy
exclusive-or and bit counts. Two fingerprints that differ in r bits have population counts at most r apart, so
tile pairs further apart are never formed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fingerprints of one tile, about; a task compares two tiles.
TILE = 8192
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Near copies by exact similarity: five-word shingles, and a radius that about 99 of 100 pairs at the least similarity are within.
SET_SHINGLE = 5
SIMILARITY = 0.8
SET_RADIUS = 16
#: Radius over two fingerprints of a set, 128 bits: about 9,996 of 10,000 pairs at the least similarity are within, and 2 of 100 million others.
WIDE_RADIUS = 33
#: Tiles of a table at most, about, so that a row is copied to so many tile pairs at any size.
TILES = 32
LEAST_TILE = 256
#: Sizes of sets are told apart by powers of this when they are dealt to tiles.
SIZE_STEP = 1.03
#: Elements of the sets of a block, about, and its sets at most, when candidates are verified.
BLOCK, BLOCK_SETS = 1 << 20, 512
#: Nearest candidates of a text that the first round verifies; the second round lists all that are still apart.
FIRST = 3


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; of the whole sequence where there are fewer."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where more than half of the hashes have it; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i:i + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None,
) -> DataFrame:
    """(id_col, fp), or all columns `keep` and __fp: a signed 64-bit SimHash of each whole text; NULL, empty and blank texts have zero."""
    names, new = ([id_col], "fp") if keep is None else (keep, "__fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(len(names))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*names, new])

    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(new, T.LongType())])
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u and v in `label`, where each node has its set's smallest node."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a tile (b None) or between two, thinned to a spanning star of each set that they connect."""
    nodes = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    step = max(1, (1 << 21) // max(len(right), 1))
    for i in range(0, len(a), step):
        near = bits_apart(a[i:i + step], right) <= radius
        rows, cols = np.nonzero(near)
        rows = rows + i
        if b is None:
            rows, cols = rows[cols > rows], cols[cols > rows]
        merge(label, rows, cols + shift)
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def tiled(nodes: DataFrame, reach: int, tile: int, columns: list[str], place: Column | None = None) -> DataFrame | None:
    """(x, y, right, columns): the tile pairs to compare and, as arrays, the `columns` of either side; None without rows.

    Rows meet those whose `place`, a number from 0 to a few hundred, is at most `reach` from theirs: the population count of `fp` if not given.
    """
    place = (F.bit_count("fp") if place is None else place).cast("int")
    counts = {r["p"]: r["count"] for r in nodes.groupBy(place.alias("p")).count().collect()}  # a row for each place
    if not counts:
        return None
    # Tiles in order of place: a frequent one has several of its own, rare ones share one.
    size = max(counts) + 1
    first, slices, n, room = [0] * size, [1] * size, 0, tile
    for p in range(size):
        c = counts.get(p, 0)
        if c > tile:
            first[p], slices[p] = n + 1, -(-c // tile)
            n, room = n + slices[p], 0
        else:
            n, room = (n, room - c) if c <= room else (n + 1, tile - c)
            first[p] = n
    # A tile reaches those that hold a place at most `reach` from one of its own: a run of tiles.
    lo, hi = {}, {}
    for p in range(size):
        q = min(size - 1, p + reach)
        lo[first[p]] = min(lo.get(first[p], n), first[max(0, p - reach)])
        hi[first[p]] = max(hi.get(first[p], 0), first[q] + slices[q] - 1)

    def at(values: list[int]) -> Column:
        return F.element_at(F.lit(np.array(values, np.int32)), place + 1)

    tiles = nodes.select(
        *columns, (at(first) + F.pmod(F.xxhash64(columns[-1]), at(slices))).cast("int").alias("tile"),
        at([lo[t] for t in first]).alias("lo"), at([hi[t] for t in first]).alias("hi"),
    ).groupBy("tile").agg(*[F.collect_list(c).alias(c) for c in columns], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = tiles.select("tile", *columns, F.explode(F.sequence("lo", "hi")).alias("other")).select(
        F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).alias("right"), *columns
    )
    # Comparing costs the square of a tile and little to move, so tasks are set by tile pairs and not by bytes.
    n_pairs = sum(slices[p] * (hi[t] - lo[t] + 1) for t, p in {first[p]: p for p in range(size)}.items()) // 2 + 1
    return pairs.repartition(max(1, min(n_pairs // 8, 10_000)), "x", "y")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over a table of distinct fingerprints `fp` that connect exactly what links of at most `radius` bits connect."""
    pairs = tiled(distinct, radius, tile, ["fp"])
    if pairs is None:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)

    def compare(table: pa.Table) -> pa.Table:
        sides = {}
        for right, fps in zip(table.column("right").to_pylist(), table.column("fp").combine_chunks()):
            sides[right] = np.sort(fps.values.to_numpy().view(np.uint64))  # unsigned: bitwise_count takes the magnitude of signed numbers
        one_tile = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        none = np.zeros(0, np.uint64)
        a, b = tile_links(sides[False], None if one_tile else sides[True], radius) if one_tile or len(sides) == 2 else (none, none)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("x", "y").applyInArrow(compare, "a long, b long")


def groups(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root) for the fingerprints that link to another one; `root` names the component."""
    return components(links(distinct, radius, tile)).withColumnRenamed("node", "fp")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE,
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row.

    `fingerprint` has 16 lowercase hex digits. `component_id` is the smallest non-NULL id that can be reached over
    fingerprints at most `radius` bits apart, the row itself included; NULL where all those ids are NULL. Texts without
    words have fingerprint zero and link like any other. Repeated rows stay; other columns are ignored; an empty table
    gives an empty one.
    """
    base = cut_lineage(fingerprints(df, id_col, text, shingle))
    distinct = cut_lineage(base.groupBy("fp").agg(F.min(id_col).alias("low")))
    joined = groups(distinct, radius, tile).join(distinct, "fp").select("fp", "root", "low")
    names = joined.join(joined.groupBy("root").agg(F.min("low").alias("least")), "root").select("fp", "least", F.lit(True).alias("linked"))
    own = distinct.join(names, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    return base.join(own, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """The rows of `df` that are alone in their component, and one row of every other: that with the smallest non-NULL id.

    Of rows with that id again, or if all ids are NULL, any one of them stays. Columns are those of `df`.
    """
    names = df.columns
    base = cut_lineage(fingerprints(df, id_col, text, shingle, keep=names))
    distinct = cut_lineage(base.groupBy("__fp").agg(F.min(id_col).alias("__low"), F.count(F.lit(1)).alias("__n")))
    roots = groups(distinct.select(F.col("__fp").alias("fp")), radius, tile).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    named = distinct.join(roots, "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    whole = named.groupBy("__root").agg(F.min("__low").alias("__least"), F.sum("__n").alias("__all")).where("__all > 1")
    crowd = cut_lineage(named.join(whole, "__root").select("__fp", "__root", "__least"))
    joined = base.join(crowd, "__fp", "left")
    alone = joined.where(F.col("__root").isNull())
    first = joined.where(F.col("__root").isNotNull() & F.col(id_col).eqNullSafe(F.col("__least"))).dropDuplicates(["__root"])
    return alone.unionByName(first).select(*[F.col(f"`{c}`") for c in names])


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash, for a second fingerprint of the same set."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(df: DataFrame, text: str, shingle: int, keep: list[str]) -> DataFrame:
    """All columns `keep` and __fp, __fp2, __node, __size: two SimHashes, key and size of each whole text's set of shingles; equal sets have equal keys."""
    new = ["__fp", "__fp2", "__node", "__size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(len(keep)))
            out = [(fingerprint(u), fingerprint(remixed(u)), xxhash.xxh64_intdigest(u.tobytes(), SEED), len(u)) for u in sets]
            fp, fp2, node, size = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fp, pa.int64()), pa.array(fp2, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64())], names=[*keep, *new])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in new])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)


def sized_tiles(nodes: DataFrame, similarity: float, tile: int, columns: list[str]) -> DataFrame | None:
    """`tiled` by `size`: a row meets those whose size allows the similarity, whatever their fingerprints."""
    places = lambda ratio: math.log(ratio) / math.log(SIZE_STEP)
    reach = math.floor(places(1 / similarity) + 1e-6) + 1
    return tiled(nodes, reach, tile, columns, F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(math.log(SIZE_STEP))))


def candidates(nodes: DataFrame, radius: int, wide: int, similarity: float, tile: int, first: int | None) -> DataFrame:
    """(a, b): nodes with different roots, at most `radius` bits apart in one fingerprint and `wide` in both, whose sizes allow the similarity.

    `nodes` has fp, fp2, size, root and node. With `first`, a node is listed with its `first` nearest others at most, ties by a hash of both.
    """
    columns = ["fp", "fp2", "size", "root", "node"]
    pairs = sized_tiles(nodes, similarity, tile, columns)
    if pairs is None:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)

    def compare(table: pa.Table) -> pa.Table:
        sides, out = {}, []
        for k, right in enumerate(table.column("right").to_pylist()):
            side = [table.column(c).combine_chunks()[k].values.to_numpy() for c in columns]
            by_size = np.argsort(side[2], kind="stable")
            sides[right] = [x[by_size] for x in side]
        one_tile = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        if one_tile or len(sides) == 2:
            (fp, other, size, root, node), (fp2, other2, size2, root2, node2) = sides[False], sides[not one_tile]
            # Both sides are in order of size, so the sizes that a row allows are one run.
            from_, to = np.searchsorted(size2, size * (similarity * (1 - 1e-9)), "left"), np.searchsorted(size2, size * ((1 + 1e-9) / similarity), "right")
            i = 0
            while i < len(fp):
                step = min(max(1, (1 << 21) // max(int(to[i] - from_[i]), 1)), 4096)
                low, high = int(from_[i]), int(to[min(i + step, len(fp)) - 1])
                u, v = np.nonzero(bits_apart(fp[i:i + step].view(np.uint64), fp2[low:high].view(np.uint64)) <= radius)
                u, v, i = u + i, v + low, i + step
                apart = np.bitwise_count((fp[u] ^ fp2[v]).view(np.uint64)).astype(np.int16) + np.bitwise_count((other[u] ^ other2[v]).view(np.uint64))
                fits = (apart <= wide) & (root[u] != root2[v]) & (np.minimum(size[u], size2[v]) >= similarity * np.maximum(size[u], size2[v]))
                if one_tile:
                    fits &= u < v
                u, v, apart = u[fits], v[fits], apart[fits]
                mix = ((node[u] ^ node2[v]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                if first is not None and len(u):
                    near = np.zeros(len(u), bool)
                    for side in (u, v):
                        order = np.lexsort((mix, apart, side))
                        place = np.arange(len(side)) - np.searchsorted(side[order], side[order], "left")
                        near[order[place < first]] = True
                    u, v, apart, mix = u[near], v[near], apart[near], mix[near]
                out.append((node[u], node2[v], apart.astype(np.int32), mix))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        return pa.table(dict(zip(("a", "b", "apart", "mix"), (np.concatenate(c) for c in zip(*out, none)))))

    found = pairs.groupBy("x", "y").applyInArrow(compare, "a long, b long, apart int, mix long")
    if first is None:
        return found.select("a", "b")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart", "mix"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("apart", "mix"))  # at most 2 * first rows a node and tile pair
    return both.withColumn("place", place).where(F.col("place") <= first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, base: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """The `pairs` (a, b) of nodes whose sets of shingles have at least that Jaccard similarity, exactly."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("a").alias("__node")).unionByName(pairs.select(F.col("b").alias("__node"))).distinct()
    texts = base.select("__node", F.col(f"`{text}`").cast("string").alias("text")).join(wanted, "__node", "left_semi").dropDuplicates(["__node"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    sets = cut_lineage(texts.mapInArrow(work, "node long, set array<long>"))
    met = blocks(pairs, sets)
    needed = met.select("x", "y", F.col("a").alias("node")).unionByName(met.select("x", "y", F.col("b").alias("node"))).distinct().join(sets, "node").toDF("node", "u", "v", "set")

    def compare(links_: pa.Table, members: pa.Table) -> pa.Table:
        own = {n: v.values.to_numpy() for n, v in zip(members.column("node").to_pylist(), members.column("set"))}
        near = np.zeros(links_.num_rows, bool)
        for i, (a, b) in enumerate(zip(links_.column("a").to_pylist(), links_.column("b").to_pylist())):
            both = len(np.intersect1d(own[a], own[b], assume_unique=True))
            near[i] = both >= similarity * (len(own[a]) + len(own[b]) - both)
        return links_.select(["a", "b"]).filter(pa.array(near))

    return cut_lineage(met.groupBy("x", "y").cogroup(needed.groupBy("u", "v")).applyInArrow(compare, "a long, b long"))


def blocks(pairs: DataFrame, sets: DataFrame, elements: int = BLOCK, most: int = BLOCK_SETS) -> DataFrame:
    """`pairs` with x and y, the blocks of both nodes; every pair is in one group (x, y).

    Nodes whose neighbours lead to one smallest node share blocks, so a family of candidates sends each of its sets to a few
    groups and not to each of its pairs. A block has about so many `elements`, and `most` sets, so large families have many.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("b"), F.least("a", "low").alias("low"))
    family = both.join(first, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("family"))
    sized = family.join(sets.select("node", F.size("set").alias("n")), "node")
    counts = sized.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / elements), F.ceil(F.count(F.lit(1)) / most)).alias("parts"))
    places = cut_lineage(sized.join(counts, "family").select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")))
    met = pairs.join(places.select(F.col("node").alias("a"), F.col("block").alias("p")), "a").join(places.select(F.col("node").alias("b"), F.col("block").alias("q")), "b")
    return cut_lineage(met.select("a", "b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")))


def keep_one_similar(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = SET_RADIUS, wide: int = WIDE_RADIUS, shingle: int = SET_SHINGLE,
    similarity: float = SIMILARITY, tile: int | None = None,
) -> DataFrame:
    """`keep_one` over texts whose sets of `shingle`-word runs have at least that Jaccard similarity.

    SimHashes of the sets at most `radius` bits apart, and `wide` with a second one, are candidates, and every link is
    verified on the whole sets. The first round verifies the nearest candidates of each text; the second all candidates that
    verified links have not joined yet, so that a crowd of near copies gives no table of all its pairs. Texts with
    equal sets need no link. Tiles grow with the table (`tile` rows if given), so a row meets a fixed number of them.
    """
    names = df.columns
    base = cut_lineage(shingle_sets(df, text, shingle, names))
    nodes = cut_lineage(base.groupBy("__node").agg(
        F.first("__fp").alias("fp"), F.first("__fp2").alias("fp2"), F.first("__size").alias("size"), F.min(id_col).alias("__low"), F.count(F.lit(1)).alias("__n"),
    ).withColumnRenamed("__node", "node"))
    tile = tile or max(LEAST_TILE, -(-nodes.count() // TILES))
    edges = None
    for first in (FIRST, None):
        if edges is None:
            rooted = nodes.withColumn("root", F.col("node"))
        else:
            rooted = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = verified(candidates(rooted.where("size > 0"), radius, wide, similarity, tile, first), base, text, shingle, similarity)
        edges = found if edges is None else edges.unionByName(found)
    named = nodes.join(components(edges), "node", "left").select(F.col("node").alias("__node"), F.coalesce("root", "node").alias("__root"), "__low", "__n")
    whole = named.groupBy("__root").agg(F.min("__low").alias("__least"), F.sum("__n").alias("__all")).where("__all > 1")
    crowd = cut_lineage(named.join(whole, "__root").select("__node", "__root", "__least"))
    joined = base.join(crowd, "__node", "left")
    alone = joined.where(F.col("__root").isNull())
    kept = joined.where(F.col("__root").isNotNull() & F.col(id_col).eqNullSafe(F.col("__least"))).dropDuplicates(["__root"])
    return alone.unionByName(kept).select(*[F.col(f"`{c}`") for c in names])
