"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key's hash. It starts with one bucket of depth 0; only buckets over
the byte limit split, on one more bit, until each fits. Bytes are summed per prefix before they are shuffled, so what
is held at once grows with the number of shards, not of rows, and the directory is a DataFrame throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release

#: Bits of the hash: as many levels as the directory can have.
BITS = 56


def key_hash(key: Column) -> Column:
    """The first 56 bits of the MD5 of the key as text, as a long; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Shards of rows (``h`` hash, ``bytes``): ``prefix`` long, ``depth`` int, ``shard_bytes`` long, ``shard_rows`` long.

    Works down in rounds of some bits. A round sums the bytes of each prefix at its last level, rolls the sums up
    through its levels, and closes each bucket at the first level where it fits; buckets that are too large at the
    round's last level go into the next one alone. Rows with one and the same hash cannot be parted: their bucket
    is closed at the last level with more than the limit.
    """
    total = sizes.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    start = 0
    end = min(BITS, max(1, math.ceil(math.log2(max(1, (total[0] or 0)) / limit + 1)) + 3))
    todo, closed = sizes, []
    while True:
        leaves = durable(todo.groupBy(F.shiftright("h", BITS - end).alias("leaf")).agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")), "leaves")
        levels = F.sequence(F.lit(start), F.lit(end))
        up = leaves.select("*", F.explode(levels).alias("depth")).withColumn("prefix", F.expr(f"shiftright(leaf, {end} - depth)"))
        sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        # A bucket is open while each of its ancestors is too large, so the first level that fits is a shard.
        large = F.col("shard_bytes") > limit
        parents = sums.where(large).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        child = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
        tops = sums.where(F.col("depth") == start)
        found = tops.unionByName(child) if start == 0 else child
        final = end == BITS
        done = durable(found.where(~large | (F.lit(final) & (F.col("depth") == end))).select("prefix", "depth", "shard_bytes", "shard_rows"), "shards")
        closed.append(done)
        rest = sums.where(large & (F.col("depth") == end)).select(F.col("prefix").alias("leaf"))
        if final or rest.isEmpty():
            release(leaves)
            break
        todo = todo.withColumn("leaf", F.shiftright("h", BITS - end)).join(rest, "leaf", "left_semi").drop("leaf")
        start, end = end, min(BITS, end + step)
    out = closed[0]
    for d in closed[1:]:
        out = out.unionByName(d)
    return out


def assign_shards(docs: DataFrame, limit: int = 8 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The shard of each row: ``key``, ``n_bytes`` long (UTF-8 of the text, null: 0), ``shard_prefix`` long (the
    directory's leading bits), ``shard_depth`` int (how many), ``shard_bytes`` and ``shard_rows`` long (of the shard).

    A shard holds ``limit`` bytes at most, unless a single key has more. Repeated rows share a key and so a shard; null
    keys share one too. An empty table has no rows and no shards. Other columns are left out.
    """
    sized = docs.select(docs[key].alias("__key"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("bigint").alias("__bytes"))
    # Keys are summed first, so the rest of the work sees a hot key once.
    sizes = durable(sized.groupBy(key_hash(F.col("__key")).alias("h")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "sizes")
    shards = directory(sizes, limit)
    # A shard's hashes form a range: those of its prefix. Its rows are found by looking the prefix up at each depth that occurs.
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())
    if not depths:
        depths = [0]
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright(F.col("h"), BITS - d).alias("prefix")) for d in depths])
    placed = sizes.select("h", F.explode(tries).alias("t")).select("h", "t.depth", "t.prefix").join(shards, ["depth", "prefix"])
    placed = placed.select("h", F.col("prefix").alias("shard_prefix"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows")
    keyed = sized.withColumn("h", key_hash(F.col("__key")))
    return keyed.join(placed, "h").select(F.col("__key").alias(key), F.col("__bytes").alias("n_bytes"), "shard_prefix", "shard_depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int = 8 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` as Parquet, a folder for each shard named by depth and prefix, each in one file; returns the
    assignment. Rows are dealt by shard, each shard into one partition, as it fits the limit by construction."""
    placed = assign_shards(docs, limit, text, key).select(F.col(key).alias("__key"), "shard_depth", "shard_prefix").distinct()
    rows = docs.join(placed, docs[key].eqNullSafe(placed["__key"])).drop("__key")
    rows.repartition("shard_depth", "shard_prefix").write.partitionBy("shard_depth", "shard_prefix").parquet(path)
    return placed
