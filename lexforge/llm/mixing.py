"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and a cap whose words add up to each source's target, the one closest to "every document
once" in relative entropy is exponentially tilted: ``rate = min(cap, exp(lambda * size))``, with one multiplier for each
source's token constraint. The multipliers solve a convex dual; Newton steps find them for all sources at once, each an
aggregation over the sources' size histograms. Rates, which depend on source and size alone, are then rounded into whole
copies of each size, carrying the words that rounding adds or loses from size to size, largest first, so that a source's
words end within a few words of its target. The copies of a size are dealt evenly to its documents, in order of a hash and
the key, in groups of bounded size.

Sources, histograms and documents stay in tables; the driver sees sums alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release

#: What ends a word: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents among which one task deals copies together.
GROUP = 8192
#: Sums are of whole numbers of this part of a word, so that they do not depend on the order of rows.
GRAIN = 1 << 16


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none. Counted without holding the words: by the ends of words."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # Every word leaves one mark: runs of other characters shrink to one.
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(plain, "[^ ]+", "x"), " +", "")), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Policy:
    """Weights by source in order (repeating), the part of all words that is wanted, and the most a document is taken."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2


def numbered_sources(sized: DataFrame, policy: Policy) -> DataFrame:
    """(``source``, ``s``, ``source_size``, ``n``, ``weight``): sources in order of code points, null last, with weights in turn."""
    counts = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = F.asc_nulls_last("source")
    rows = durable(counts.repartitionByRange(order).withColumn("p", F.spark_partition_id()), "sources")
    # One row for each task of the sort.
    before = rows.groupBy("p").agg(F.count(F.lit(1)).alias("k")).select("p", F.coalesce(F.sum("k").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    s = (F.col("before") + F.row_number().over(W.partitionBy("p").orderBy(order)) - 1).alias("s")
    rows = rows.join(before, "p").select("source", s, "source_size", "n")
    weights = F.array(*[F.lit(w) for w in policy.weights])
    return rows.withColumn("weight", F.get(weights, F.pmod("s", F.lit(len(policy.weights))).cast("int")))


def with_targets(sources: DataFrame, policy: Policy) -> DataFrame:
    """``sources`` with ``full`` (can it give no more than its target) and ``target``: words by weight; what a source cannot give
    (over ``cap`` times its words) is dealt anew by weight until none is above. A round is one sum over the sources."""
    most = F.col("source_size") * policy.cap
    above = lambda unit: F.lit(unit) * F.col("weight") > most
    unit, before = 0.0, None
    while before is None or unit > before:
        over = above(unit) if before is not None else F.lit(False)
        sums = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(over, most)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight")
        ).first()
        before = unit
        if not sums["weight"]:
            break
        unit = (policy.share * int(sums["all"]) - int(sums["given"])) / int(sums["weight"])
    return sources.withColumn("full", above(unit)).withColumn("target", F.when(F.col("full"), most.cast("double")).otherwise(F.lit(unit) * F.col("weight")))


def solve_tilts(histogram: DataFrame, sources: DataFrame, cap: int, rounds: int = 60) -> DataFrame:
    """(``s``, ``tilt``) for ``histogram`` (``s``, ``size``, ``n``) and the sources that are not full: Newton steps on the dual, kept inside
    a shrinking bracket. Each step is one aggregation; the driver sees how many sources are still open."""
    start = sources.where(~F.col("full") & (F.col("source_size") > 0))
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.lit(1), F.col("n")))
    now = durable(start.select("s", "target", scale.alias("scale"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"), F.lit(0.0).alias("now"), F.lit(True).alias("open")), "tilts")
    for _ in range(rounds):
        open_ = now.where("open")
        if open_.isEmpty():
            break
        rate = F.exp(F.least(F.lit(700.0), F.col("now") / F.col("scale") * F.col("size")))
        x = F.col("size") * F.least(F.lit(float(cap)), rate)
        slope = F.when(rate < cap, F.col("size").cast("double") * F.col("size") * rate).otherwise(F.lit(0.0))
        # Whole numbers, so that sums do not depend on the order of rows.
        whole = lambda c: F.sum((F.round(c) * F.col("n")).cast("decimal(38,0)")).cast("double")
        sums = histogram.join(open_.select("s", "now", "scale"), "s").groupBy("s").agg(whole(x * GRAIN).alias("f"), whole(slope).alias("d"))
        step = now.join(sums, "s", "left").withColumn("gap", F.col("f") / GRAIN - F.col("target"))
        open_now = F.col("open") & F.col("gap").isNotNull() & (F.abs("gap") > F.greatest(F.lit(0.05), F.col("target") * 1e-9))
        step = step.withColumn("open", open_now).withColumn("high", F.when(F.col("gap") > 0, F.col("now")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("gap") <= 0, F.col("now")).otherwise(F.col("low")))
        newton = F.col("now") - F.col("gap") * F.col("scale") / F.nullif(F.col("d"), F.lit(0.0))
        inside = (F.col("low") < newton) & (newton < F.col("high"))
        new = F.when(~F.col("open"), F.col("now")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        before, now = now, durable(step.select("s", "target", "scale", "low", "high", new.alias("now"), "open"), "tilts")
        release(before)
    return now.select("s", (F.col("now") / F.col("scale")).alias("tilt"))


def round_sizes(sizes: list[int], counts: list[int], rates: list[float], cap: int) -> list[int]:
    """Copies of all documents of each size, sizes in falling order: what is wanted is rounded with the words carried from the
    sizes before; no document gets more than ``cap`` copies."""
    out, carry = [], 0.0
    for x, n, r in zip(sizes, counts, rates, strict=True):
        if x <= 0:
            out.append(n)  # nothing to weigh: kept as they are
            continue
        wanted = n * r + carry / x
        copies = min(cap * n, max(0, math.floor(wanted + 0.5)))
        out.append(copies)
        carry = (wanted - copies) * x
    return out


def mix(docs: DataFrame, policy: Policy | None = None, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """How often the mix takes each document.

    Returns ``key``, ``size`` long (words), ``source_size`` long, ``target`` double (both of its source), ``rate`` double
    (the exponentially tilted rate), ``copies`` long and ``taken`` long (``copies * size``). Documents without words have
    rate and copies 1 and taken 0. Null sources are one source. Rows that repeat, key included, are documents of
    their own, with interchangeable copies. An empty table gives no rows. There may be any number of sources, and of
    rows of a source, a size or a key; one task rounds a source's distinct sizes.
    """
    policy = policy or Policy()
    cap = policy.cap
    sized = durable(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    sources = durable(with_targets(durable(numbered_sources(sized, policy), "sources"), policy), "targets")
    # Rows that agree in all that counts are one, which occurs m times; a hot one is summed per task before the shuffle.
    each = sized.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("m"))
    numbers = sources.select(F.col("source").alias("of"), "s")
    each = durable(each.join(numbers, F.col("source").eqNullSafe(F.col("of"))).select("s", "key", "size", "m"), "rows")
    histogram = durable(each.groupBy("s", "size").agg(F.sum("m").alias("n")), "histogram")
    tilts = solve_tilts(histogram, sources, cap)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size"))))
    rate = F.when(F.col("size") <= 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).otherwise(F.round(tilted, 9))
    rated = histogram.join(sources.drop("n", "source", "weight"), "s").join(tilts, "s", "left").withColumn("rate", rate).drop("tilt", "full")

    def rounded(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("size", ascending=False)
        return g.assign(total=round_sizes(g["size"].tolist(), g["n"].tolist(), g["rate"].tolist(), cap))

    dealt = rated.select("s", "size", "n", "source_size", "target", "rate").groupBy("s").applyInPandas(rounded, "s bigint, size bigint, n bigint, source_size bigint, target double, rate double, total bigint")
    dealt = durable(dealt, "dealt")
    # The copies of a size go to groups of its documents by their numbers, and in a group to documents in order.
    group = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / GROUP)).alias("g")
    placed = each.join(dealt.select("s", "size", "n"), ["s", "size"]).select("s", "size", group, "key", "m")
    groups = placed.groupBy("s", "size", "g").agg(F.sum("m").alias("of_group")).join(dealt, ["s", "size"])

    def share(k: Column, total: Column, n: Column) -> Column:
        """Whole part of k * total / n, in decimals, as numbers of rows are multiplied."""
        product = k.cast("decimal(19,0)") * total.cast("decimal(19,0)")
        return ((product - product % n) / n).cast("bigint")

    upto = F.sum("of_group").over(W.partitionBy("s", "size").orderBy("g"))
    mine = share(upto, F.col("total"), F.col("n")) - share(upto - F.col("of_group"), F.col("total"), F.col("n"))
    groups = groups.withColumn("of_total", mine).drop("n", "total")
    rows = placed.join(groups, ["s", "size", "g"])
    upto = F.sum("m").over(W.partitionBy("s", "size", "g").orderBy("key"))
    rows = rows.withColumn("all", share(upto, F.col("of_total"), F.col("of_group")) - share(upto - F.col("m"), F.col("of_total"), F.col("of_group")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    copies = F.floor(F.col("all") / F.col("m")) + (F.col("k") <= F.pmod(F.col("all"), F.col("m"))).cast("bigint")
    rows = rows.withColumn("copies", copies.cast("bigint"))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, policy: Policy | None = None, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of ``docs``, which may have any names. Where
    keys do not tell rows apart, rows are numbered, and the mix is that of the numbers."""
    columns = list(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    text, source, key = (f"c{columns.index(c)}" for c in (text, source, key))
    if not plain.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        plain, key = durable(plain.withColumn("row", F.monotonically_increasing_id()), "rows"), "row"
    taken = mix(plain, policy, text, source, key).where("copies > 0").select(F.col(key).alias("own"), "copies")
    rows = plain.join(durable(taken, "taken"), plain[key].eqNullSafe(F.col("own")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select(*[f"c{k}" for k in range(len(columns))]).toDF(*columns)
