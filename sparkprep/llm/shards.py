"""Sharding by vector bin packing.

Groups of equal texts are vectors (bytes, tokens, rows). Small groups are bundled by hash and large ones are cut into
pieces, so that the number of items to pack is bounded by parameters whatever the table's size. Each item goes to the
shard with the largest dot product between its vector and the shard's residual capacity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import WORD

SHARDS = 24
#: Bundles for each shard; a piece is at most this part of a shard in every dimension, but for single long rows.
BUNDLES = 256


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (one row of non-negative sizes per item), largest items first.

    Sizes are measured in shares of a shard's capacity. A shard that the item would fill beyond its capacity is taken
    only when all would be.
    """
    total = items.sum(axis=0)
    share = items * shards / np.where(total > 0, total, 1)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    order = np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))) if len(items) else []
    for i in order:
        fits = (left >= share[i] - 1e-9).all(axis=1)
        score = left @ share[i]
        s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = s
        left[s] -= share[i]
    return out


def shard_rows(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, bundles: int = BUNDLES,
) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, n_tokens) for every row.

    `size` is the text's UTF-8 bytes plus 8 (NULL: 8), `text_crc32` its unsigned CRC-32 (NULL: NULL), `n_tokens` its
    words. Law `bytes`: bytes, words and rows are balanced together. Rows of one text share a shard as long as the
    group is at most a 1/`bundles` part of a shard; larger groups are cut so that a hot text can't fill a shard.
    `slot` numbers a shard's rows from 0 without gaps; `grown_shard` is NULL under this law. Large groups are dealt by
    a number that each row gets once, so rows repeated with their ids are spread like others and get their own slots;
    which rows of a large group share a piece follows the order of the input. NULL ids are rows like others; an empty
    table gives an empty one.
    """
    body = F.col(text).cast("string")
    base = cut_lineage(df.select(
        id_col, (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64(body).alias("__group"),
        F.monotonically_increasing_id().alias("__row"),
    ))
    total = base.agg(F.count(F.lit(1)).alias("r"), F.sum("size").alias("b"), F.sum("n_tokens").alias("t")).first()
    most = shards * bundles
    cut = {k: max((total[k] or 0) / most, 1) for k in "rbt"}
    groups = base.groupBy("__group").agg(F.count(F.lit(1)).alias("r"), F.sum("size").alias("b"), F.sum("n_tokens").alias("t"))
    pieces = F.ceil(F.greatest(*[F.col(k) / F.lit(cut[k]) for k in "rbt"])).cast("int")
    # At most 3 x shards x bundles groups exceed a piece, so this table has a bounded size whatever the input's.
    large = groups.select("__group", F.least(pieces, F.col("r").cast("int")).alias("__pieces")).where("__pieces > 1")
    item = F.when(F.col("__pieces").isNull(), F.struct(F.lit(0).cast("long").alias("g"), F.pmod("__group", F.lit(most)).cast("int").alias("k"))).otherwise(
        F.struct(F.col("__group").alias("g"), (1 + F.pmod(F.xxhash64("__row"), F.col("__pieces"))).cast("int").alias("k"))
    )
    rows = base.join(F.broadcast(large), "__group", "left").withColumn("__item", F.struct(F.col("__pieces").isNotNull().alias("cut"), item.alias("at")))
    rows = rows.select(id_col, "size", "text_crc32", "n_tokens", "__group", F.col("__item.cut").alias("__c"), F.col("__item.at.g").alias("__g"), F.col("__item.at.k").alias("__k"))
    sums = rows.groupBy("__c", "__g", "__k").agg(F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    found = sorted(tuple(r) for r in sums.collect())  # bounded: bundles and pieces, at most about 7 x shards x bundles
    chosen = pack(np.array([f[3:] for f in found], float).reshape(-1, 3), shards)
    offset, place = [0] * shards, []
    for f, s in zip(found, chosen.tolist()):
        place.append((*f[:3], s, offset[s]))
        offset[s] += f[5]
    schema = T.StructType([
        T.StructField("__c", T.BooleanType()), T.StructField("__g", T.LongType()), T.StructField("__k", T.IntegerType()),
        T.StructField("shard", T.IntegerType()), T.StructField("__from", T.LongType()),
    ])
    own = Window.partitionBy("__c", "__g", "__k").orderBy(id_col, "size", "__group", "text_crc32")
    numbered = rows.withColumn("__n", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(df.sparkSession.createDataFrame(place, schema)), ["__c", "__g", "__k"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__from") + F.col("__n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )
