"""Running sums and ordinals that no single task computes for a whole group.

A window over a group sorts and scans it in one task; a group that holds a third of all rows then sets the time of all.
Here a group's rows are cut into ranges of the ordering column, summed and numbered within each range, and shifted by the
sums of the ranges before, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a range, about; where that would make more than ``MOST`` ranges, all are larger instead.
RANGE, MOST = 100_000, 1 << 16


def ranges(df: DataFrame, order: str, rows: int | None = None) -> list:
    """Ends of ranges of ``order`` with about so many rows of ``df``; what the driver gets is a number for each range."""
    n = df.count()
    parts = -(-n // max(rows or RANGE, n // MOST))
    if parts < 2:
        return []
    at = ", ".join(str(k / parts) for k in range(1, parts))
    ends = df.selectExpr(f"percentile_approx(`{order}`, array({at}), {max(10_000, 4 * parts)}) as q").first()[0] or []
    return sorted(set(ends))


def range_number(value: Column, ends: list, kind: str) -> Column:
    """How many of the sorted ``ends`` (of SQL type ``kind``) are below ``value``: looked for among every n-th, then among n."""
    of = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast(f"array<{kind}>")
    below = lambda some: F.size(F.filter(some, lambda e: e < value))
    step = max(1, int(len(ends) ** 0.5))
    block = below(of(ends[step - 1 :: step]))
    return block * step + below(F.slice(of(ends), block * step + 1, F.lit(step)))


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with its rows' places (from 1) in an order, by a sort that is dealt out: rows are numbered within each part of the
    sort and shifted by the sizes of the parts before. Rows that are equal in ``order`` get places in any order."""
    parts = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "placed")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each part
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = parts.join(F.broadcast(before), "__p")
    return rows.select(*df.columns, (F.row_number().over(W.partitionBy("__p").orderBy(*order)) + F.col("__before")).cast("bigint").alias(name))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], ends: list | None = None) -> DataFrame:
    """``df`` with, for each of ``sums`` (column: name of its result), the sum of the rows of the same keys that come before
    in ``order`` (a unique number within the keys), 0 for the first. A column of ones gives an ordinal from 0."""
    ends = ranges(df.select(order), order) if ends is None else ends
    if not ends:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(name) for c, name in sums.items()])
    rows = df.withColumn("__part", range_number(F.col(order), ends, df.schema[order].dataType.simpleString()))
    totals = rows.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{name}") for c, name in sums.items()])
    over = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__{name}").over(over), F.lit(0)).alias(f"__{name}") for name in sums.values()])
    inner = W.partitionBy(*keys, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(name) for c, name in sums.items()]).join(before, [*keys, "__part"])
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).cast("bigint").alias(name) for name in sums.values()])
