"""Sharding by extendible hashing.

A row's 60 hash bits are 32 of its key and 28 of its content, so a hot key is split by its rows' contents. A bucket is a
prefix of these bits; only a bucket over the byte limit splits on another bit. Bucket sizes come from one pre-aggregated
histogram of fine prefixes (cells), never from rows gathered in one place; cells that are still too large get more bits in
another round. Rows that agree in key and content can't be parted and stay in one bucket, flagged ``oversized``, as does a
single row over the limit.

Defined cases: null text is empty (0 bytes); a very long text is a shard of its own, flagged if it is over the limit; tied
hashes share a shard; a null key hashes as the empty string; repeated rows each get a row of the
result; an empty table gives an empty result; other columns travel in one struct, so their names meet
none of this module's; of those named like an added column the added one wins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 60
ADDED = ["n_bytes", "depth", "shard_id", "shard_bytes", "shard_rows", "oversized"]


def _bits(c, digits: int):
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def extendible_shards(df: DataFrame, key: str, content: str, limit: int) -> DataFrame:
    """Add the shard of each row: ``depth`` bits of the hash, as ``shard_id`` "depth:prefix"."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        (F.shiftleft(_bits(F.coalesce(F.col(key).cast("string"), F.lit("")), 8), 28) + _bits(text, 7)).alias("_h"),
    )
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    deep = min(BITS, max(6, math.ceil(math.log2(max(total, 1) / limit + 1)) + 6))
    out, rest, low = None, rows, 0
    while True:
        at = rest.withColumn("_cell", F.shiftright("_h", BITS - deep))
        cells = at.groupBy("_cell").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(deep)))).withColumn("_prefix", F.expr(f"shiftright(_cell, {deep} - depth)"))
        sums = levels.groupBy("depth", "_prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        if deep == BITS:
            fits = fits | (F.col("depth") == BITS)
        found = levels.select("_cell", "depth", "_prefix").join(sums.filter(fits), ["depth", "_prefix"])
        directory = found.groupBy("_cell").agg(F.min_by(F.struct("depth", "_prefix", "shard_bytes", "shard_rows"), "depth").alias("_d"))
        part = at.join(directory, "_cell").select(
            "_row",
            "n_bytes",
            F.col("_d.depth").alias("depth"),
            F.concat_ws(":", F.col("_d.depth").cast("string"), F.col("_d._prefix").cast("string")).alias("shard_id"),
            F.col("_d.shard_bytes").alias("shard_bytes"),
            F.col("_d.shard_rows").alias("shard_rows"),
            (F.col("_d.shard_bytes") > limit).alias("oversized"),
        )
        out = part if out is None else out.unionByName(part)
        if deep == BITS:
            break
        large = cells.filter((F.col("b") > limit) & (F.col("n") > 1)).select("_cell")
        if large.isEmpty():
            break
        rest = at.join(large, "_cell", "left_semi").drop("_cell")
        low, deep = deep + 1, min(BITS, deep + 12)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ADDED), *ADDED)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own; a shard is within the limit, so one task writes it."""
    sharded.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)
