"""Near-duplicate embeddings by random hyperplanes, exact cosines and connected components.

Several tables each give a vector the signs of its products with a few random hyperplanes as a code. Vectors that share a
code in a table are compared exactly, in double precision, block by block; a pair that meets in several tables counts in
the first of them alone. The number of tables follows from the threshold and the length of the codes, so that a pair right
at the threshold is missed with a stated probability; closer pairs far less often. Equal vectors are one point that
counts as often as it occurs. No pair leaves a block: what leaves is each vector's number of links and a forest that ties
the linked ones together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, release
from .components import components

#: Points of a block of a bucket.
BLOCK_POINTS = 1024
#: Probability that a pair right at the threshold meets in no table.
MISS = 1e-3


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: codes long enough that unrelated vectors rarely share one, and as many tables as
    the probability of a miss asks for."""
    bits = min(40, max(10, math.ceil(math.log2(max(2, n))) + 3))
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits, tables]).standard_normal((dim, bits * tables))


def codes(signs: np.ndarray, bits: int) -> np.ndarray:
    """Codes (rows by tables) of the signs of products with all hyperplanes."""
    return (signs.reshape(len(signs), -1, bits).astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def valid_vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(``key``, ``v`` binary, ``dim``) of the vectors that can link: no null or non-finite component, not zero. Components are as
    wide as the column's, floats or else doubles; whatever they are, they are compared as doubles."""
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    wide = np.float32 if single else np.float64
    source = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    source = source.where("key is not null and v is not null and size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            off -= off[0]
            flat = lists.flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(wide) + wide(0)  # one zero only, not two
            size = np.abs(x)
            size[null | ~np.isfinite(x)] = np.inf
            top = np.maximum.reduceat(size, off[:-1])
            good = np.flatnonzero(np.isfinite(top) & (top > 0))
            if not single:
                scale = np.where((top > 1e-100) & (top < 1e100), 1.0, top)  # others' squares would leave the range of doubles
                x = x / np.repeat(np.where(np.isfinite(scale) & (scale > 0), scale, 1.0), np.diff(off))
            raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(off * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), raw.take(at).cast(pa.binary()), pa.array(np.diff(off)[good].astype(np.int32))], ["key", "v", "dim"])

    return source.mapInArrow(run, "key bigint, v binary, dim int")


def doubles(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of ``dim`` components, floats or doubles, as unit vectors of doubles."""
    data = b"".join(raw)
    return _unit(np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(raw) else np.float64).astype(np.float64).reshape(len(raw), dim))


def link_blocks(rows: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(``a``, ``b``, ``links``): ``b`` null: vector ``a`` has so many links in this block; else an edge of a forest.

    ``rows``: ``t`` table, ``code``, ``dim``, ``i`` and ``j`` blocks, ``upper`` (which of the two), ``rep``, ``n`` (how often the vector
    occurs), ``v``, ``signs`` (bits of all codes, table by table)."""
    rows = rows.repartition("t", "code", "dim", "i", "j").sortWithinPartitions("t", "code", "dim", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tell(part: list[pa.RecordBatch], links: dict[int, int], edges: set[tuple[int, int]]) -> None:
            """Works through whole groups, in order."""
            table = pa.Table.from_batches(part)
            group = [table.column(k).to_numpy() for k in range(5)]
            upper, rep, count = (table.column(k).to_numpy() for k in (5, 6, 7))
            new = np.ones(len(rep), bool)
            new[1:] = np.any([g[1:] != g[:-1] for g in group], axis=0)
            bounds = [*np.flatnonzero(new).tolist(), len(rep)]
            raw, code = table.column(8), table.column(9)
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s < 2:
                    continue
                x = doubles(raw.slice(s, e - s).to_pylist(), int(group[2][s]))
                t, inner = int(group[0][s]), group[3][s] == group[4][s]
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if not inner:
                    near &= upper[s:e][:, None] != upper[s:e][None, :]
                if not near.any():
                    continue
                a, b = np.nonzero(np.triu(near))
                if t:  # those that meet here first
                    c = np.frombuffer(b"".join(code.slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1)
                    c = np.unpackbits(c, axis=1, count=t * bits).reshape(e - s, t, bits)
                    once = np.concatenate([~(c[a[k : k + 4096]] == c[b[k : k + 4096]]).all(2).any(1) for k in range(0, len(a), 4096)])
                    a, b = a[once], b[once]
                r, n = rep[s:e], count[s:e]
                sums = np.bincount(a, n[b], e - s) + np.bincount(b, n[a], e - s)
                for k in np.flatnonzero(sums).tolist():
                    links[int(r[k])] = links.get(int(r[k]), 0) + int(sums[k])
                up = list(range(e - s))

                def root(k: int, up=up) -> int:
                    while up[k] != k:
                        up[k] = up[up[k]]
                        k = up[k]
                    return k

                # All links tie; those found before do too, so a forest of this block's own is enough.
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    x0, y0 = root(p), root(q)
                    if x0 != y0:
                        up[max(x0, y0)] = min(x0, y0)
                        edges.add((int(min(r[p], r[q])), int(max(r[p], r[q]))))

        def out(links: dict[int, int], edges: set[tuple[int, int]]) -> pa.RecordBatch:
            a = [*links, *(e[0] for e in edges)]
            b = [*[None] * len(links), *(e[1] for e in edges)]
            n = [*links.values(), *[0] * len(edges)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

        links: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            g = [batch.column(k).to_numpy() for k in range(5)]
            last = int(np.argmax(np.all([x == x[-1] for x in g], axis=0)))
            joins = bool(held) and all(held[-1].column(k)[0].as_py() == g[k][0] for k in range(5))
            if held and (last or not joins):
                tell([*held, batch.slice(0, last)], links, edges)
                held = []
            elif last:
                tell([batch.slice(0, last)], links, edges)
            held.append(batch.slice(last))
            if len(links) + len(edges) > 50_000:
                yield out(links, edges)
                links, edges = {}, set()
        if held:
            tell(held, links, edges)
        yield out(links, edges)

    return rows.select("t", "code", "dim", "i", "j", "upper", "rep", "n", "v", "signs").mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Links and components of vectors whose cosine is ``threshold`` or more.

    Returns one row per vector: ``key`` long, ``n_links`` long (other vectors linked directly), ``component_id`` (the smallest
    key reachable by links, itself included) and ``kept`` (is it that one). Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, nor do vectors of different lengths, nor a vector without a
    key (its component is null, and it is not kept). Rows that repeat a key are vectors of their own, and equal vectors
    are linked. No pair below the threshold is linked; one right at it is missed with probability ``MISS``, one of cosine
    0.97 with about a thousandth of that. Nothing else depends on chance: the hyperplanes are fixed. An empty table
    gives no rows. Other columns are left out.
    """
    valid = durable(valid_vectors(vectors, key, embedding).withColumn("hash", F.xxhash64("v")), "vectors")
    # Equal vectors are one; a frequent one is summed per task before the shuffle.
    points = durable(valid.groupBy("dim", "hash", "v").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")), "points")
    total = points.count()
    bits, tables = plan(total, threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                dims = part.column(1).to_numpy()
                out = np.zeros((len(dims), tables * bits), bool)
                for d in np.unique(dims).tolist():
                    if d not in planes:
                        planes[d] = hyperplanes(d, bits, tables)
                    at = np.flatnonzero(dims == d)
                    out[at] = doubles(part.column(2).take(pa.array(at)).to_pylist(), d) @ planes[d] > 0
                packed = np.packbits(out, axis=1)
                number = codes(out, bits)
                signs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(dims), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables), pa.array(number.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), signs, lists], ["rep", "dim", "v", "n", "signs", "list"])

    own = durable(points.select("rep", "dim", "v", "n").mapInArrow(coded, "rep bigint, dim int, v binary, n bigint, signs binary, list array<bigint>"), "codes")
    places = own.select("rep", "dim", F.posexplode("list").alias("t", "code"))
    # Buckets of one vector end here: they are counted on the codes alone, before any vector is moved.
    full = places.groupBy("t", "code", "dim").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK_POINTS).cast("int").alias("blocks")
    met = durable(places.join(full.select("t", "code", "dim", blocks), ["t", "code", "dim"]), "met")
    rows = met.join(own.select("rep", "v", "n", "signs"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("t", "code", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("upper"), "rep", "n", "v", "signs")
    found = durable(link_blocks(rows, threshold, bits), "links")
    release(met, own)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = durable(components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component"), "components")
    each = points.select("dim", "hash", "v", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    each = each.select("dim", "hash", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(each, ["dim", "hash", "v"]).select(F.col("key"), "n_links", "component_id")
    # Rows that cannot link: all others. Keys that repeat are matched by their number among equal keys.
    everything = vectors.select(F.col(key).cast("bigint").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    rest = everything.join(valid.groupBy("key").agg(F.count(F.lit(1)).alias("valid")), "key", "left")
    rest = rest.select("key", F.explode(F.sequence(F.lit(0), (F.col("rows") - F.coalesce("valid", F.lit(0))).cast("int"))).alias("k")).where("k > 0")
    rest = rest.select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
