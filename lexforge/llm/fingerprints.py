"""Document fingerprints: one-permutation MinHash, with DataFrame functions alone.

Each word shingle is hashed once; the top bits of the hash are its bin, and a bin keeps its smallest hash. An empty bin takes
the value of the first bin, of a sequence that the bin's number determines, that is not empty (optimal densification).
Of each value the low bits are kept, packed into longs. Two fingerprints agree in a part of their bins; of that, what
unequal values agree in by chance is taken off.

The bins' smallest hashes come from one sort of a document's hashes: with the largest possible value of each bin mixed in,
the first of each bin is its smallest hash or that value, and so all bins are there, in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: Words of a shingle; bins (a power of two, at most 256) and bits kept of each.
SHINGLE, BINS, BITS = 5, 256, 8
#: Bins that an empty one looks at one by one; where all are empty too, it takes the one first in an order of its own.
TRIES = 8
#: Bytes of text of a range of keys that is ordered together; of more than ``MOST_RANGES`` such ranges, all are larger instead.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 20


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` computed once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def n_words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of ``SHINGLE`` words; fewer words are one run, and no words an empty one."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]))
    hashes = F.transform(n_words_of(text), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) >= SHINGLE, runs(h)).otherwise(F.array(F.xxhash64(h))))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint: an array of longs, ``64 / BITS`` bins in each. Equal texts have equal ones."""
    low = 64 - (BINS.bit_length() - 1)
    most = (1 << low) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    limits = F.array(*[F.lit(signed((b << low) | most)) for b in range(BINS)])
    bin_of = lambda x: F.shiftrightunsigned(x, low)
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    empty = lambda x: x.bitwiseAND(F.lit(most)) == most

    def dense(d: Column) -> Column:
        def fill(j: Column) -> Column:
            # Bins stand in the order of signed numbers; any fixed order of them serves.
            look = lambda a: F.get(d, F.pmod(F.xxhash64(j, F.lit(a)), F.lit(BINS)).cast("int"))
            tries = F.coalesce(*[let(look(a), lambda x: F.when(~empty(x), x)) for a in range(TRIES)])
            order = F.transform(d, lambda x, q: F.when(~empty(x), F.struct(F.xxhash64(j, q, F.lit(-1)).alias("o"), x.alias("x"))))
            return F.coalesce(tries, F.array_min(order)["x"])

        return F.transform(d, lambda x, j: F.when(empty(x), fill(j)).otherwise(x))

    per = 64 // BITS

    def pack(c: Column) -> Column:
        part = lambda g, t: F.shiftleft(F.get(c, g * per + t).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * t)

        def long(g: Column) -> Column:
            out = part(g, 0)
            for t in range(1, per):
                out = out.bitwiseOR(part(g, t))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), long)

    sorted_ = lambda h: F.sort_array(F.concat(h, limits))
    return let(sorted_(shingle_hashes(text)), lambda s: let(first(s), lambda d: let(dense(d), pack)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints, from 0 to 1."""
    lows = 0x0101010101010101  # the lowest bit of each byte

    def equal_bytes(x: Column, y: Column) -> Column:
        # The lowest bit of a byte gathers all its bits; those of bytes that differ are set.
        fold = lambda z, k: z.bitwiseOR(F.shiftrightunsigned(z, k))
        return let(let(fold(x.bitwiseXOR(y), 4), lambda z: fold(z, 2)), lambda z: F.lit(8) - F.bit_count(fold(z, 1).bitwiseAND(F.lit(lows))))

    same = F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1.0 - chance))


def hex_of(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def key_ranges(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of documents in order of ``key`` and ``tie``, of about ``RANGE_BYTES`` each, for ``ids`` (``key``, ``tie``, ``bytes``).

    Returns one row with ``tops`` (the last of each range, in blocks; ``heads``: the last of each block; ``n``: ranges), and
    (``key``, ``tie``, ``m``) of documents that occur ``m`` > 1 times. Running sums go range by range of a sort of the
    identifiers; no text is moved."""
    order = ["key", "tie"]
    each = ids.groupBy(*order).agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("m"))
    each = durable(each.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "order")
    # One row for each task of the sort.
    sums = each.groupBy("p").agg(F.sum("bytes").alias("sum"))
    w = W.orderBy("p")
    sums = sums.select("p", F.coalesce(F.sum("sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("sum").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    run = F.col("before") + F.sum("bytes").over(W.partitionBy("p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    unit = F.greatest(F.lit(RANGE_BYTES), F.col("all") / MOST_RANGES)
    numbered = each.join(F.broadcast(sums), "p").select(F.floor(run / unit).alias("number"), F.struct(*order).alias("id"))
    tops = numbered.groupBy("number").agg(F.max("id").alias("top")).agg(F.sort_array(F.collect_list("top")).alias("tops"))
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("tops")))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("tops") - 1) / step).cast("int")), lambda b: F.slice("tops", b * step + 1, step))
    table = tops.where(F.size("tops") > 0).select(F.size("tops").alias("n"), step.alias("step"), blocks.alias("tops"))
    table = durable(table.withColumn("heads", F.transform("tops", lambda b: F.element_at(b, -1))), "ranges")
    return table, each.where("m > 1").select("key", "tie", "m")


def in_ranges(own: DataFrame, table: DataFrame) -> DataFrame:
    """``own`` with its range ``part`` (they grow with keys), ``top`` (is it the last of it), and ``n`` (ranges)."""
    me = F.struct("key", "tie")
    block = F.size(F.filter("heads", lambda x: x < me))
    with_block = own.crossJoin(F.broadcast(table)).withColumn("block", F.get("tops", block)).withColumn("first", block * F.col("step"))  # one row, bounded by MOST_RANGES
    inside = F.size(F.filter("block", lambda x: x < me))
    out = with_block.withColumn("inside", inside).withColumn("part", (F.col("first") + F.col("inside")).cast("int"))
    return out.withColumn("top", F.get("block", F.col("inside")) == me).select(*own.columns, "part", "top", "n")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, in which the last third (rounded down) of the code points
    makes way for as many (or all) of the first ones of the next document. Documents stand in descending order of ``key``
    (then of their text's MD5); after the last comes the first.

    Returns ``key``, ``n_chars`` long, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (hex of ``BINS`` times ``BITS``
    bits), ``near_edited`` and ``near_next`` double (likeness of the fingerprint to the edited text's, and the next
    document's). A null text is empty; texts without words are alike. Rows that repeat are documents of their own, one
    after the other; rows without a key come last. A single document is its own next. An empty table gives no rows.
    Other columns are left out; keys may be of any type that has an order.

    One shuffle of the texts, into ranges of bounded bytes: rows of one key are parted by their texts, and equal rows are one
    until the end. A range's last document goes on with the next range's first, which is sent to it alone.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.md5("text"))
    table, repeated = key_ranges(own.select("key", "tie", (F.octet_length("text") + 64).cast("bigint").alias("bytes")))
    several = not repeated.isEmpty()
    if several:
        same = [F.col("x.key").eqNullSafe(F.col("y.key")), F.col("x.tie") == F.col("y.tie")]
        once = own.alias("x").join(repeated.alias("y"), same, "left").select("x.key", "x.text", "x.tie", "y.m")
        own = once.where("m is null").unionByName(once.where("m is not null").dropDuplicates(["key", "tie"]))
    placed = in_ranges(own, table)
    w = W.partitionBy("part").orderBy(F.col("key").desc_nulls_last(), F.col("tie").desc())
    rows = placed.withColumn("print", fingerprint(F.col("text")))
    # Columns of their own, not one struct: who asks for no fingerprints has none made.
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_print", F.lead("print").over(w))
    # Keys fall, so a range is followed by the one before it, and the first by the last.
    tops = placed.where("top").select(F.pmod(F.col("part") + 1, F.col("n")).alias("part"), F.col("text").alias("head_text"), fingerprint(F.col("text")).alias("head_print"))
    other = lambda c: F.coalesce(F.col(f"next_{c}"), F.col(f"head_{c}"))
    kept = ["key", "text", "print", *(["m"] if several else [])]
    joined = rows.join(tops, "part", "left").select(*kept, other("text").alias("other"), other("print").alias("next_print"))
    if several:
        # Of equal rows all but one are followed by one of them.
        again = joined.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("m").cast("int"))))
        joined = joined.drop("m").unionByName(again.select("key", "text", "print", F.col("text").alias("other"), F.col("print").alias("next_print")))
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("other"), F.lit(1), moved))
    out = joined.select("key", n.cast("bigint").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    out = out.withColumn("edited_print", fingerprint(F.col("edited")))
    return out.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        hex_of(F.col("print")).alias("fingerprint"),
        hex_of(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
