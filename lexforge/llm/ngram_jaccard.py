"""N-gram Jaccard join with count-vector R-trees.

A document's set is that of its distinct word shingles, as 64-bit hashes. Shingles are hashed into groups; the numbers of
shingles in the groups are a point, and two sets share at most the sum over groups of the smaller count. An R-tree over
points finds, for a set, the sets whose bound lets them reach the threshold: a box is left out when the bound with its upper
corner (and the box's range of sizes) rules out all points in it. What survives is verified on the shingles themselves.

Trees are built where links can be. Sets that reach the threshold differ in at most ``d`` shingles, ``d`` following from
their sizes. The shingles of a size class are dealt into ``m`` parts, ``m`` over ``d``, so a set with ``f`` full parts agrees
with a linked one in ``f - d`` full parts at least. Only full parts are signatures; unrelated sets share none. Of its full
parts a set keeps ``d + 1`` alone and leaves out the others, the most frequent ones, in one order for all sets; it still
meets every linked set in one that both keep. A set whose shingles fill too few parts (``f <= d``) sends as many of its
shingles, in order of hash, as a linked set cannot all lack; two such sets meet in these.

The sets of a signature have a hub, the smallest. A hub's neighbourhood is all sets that it is the hub of: two sets that
share a signature are both in it, and a pair that shares a hundred signatures meets once or a few times. Signatures travel
once, packed (about 6 bytes each with their set), to where all sets of one meet. First each set is compared with one hub, by
points and then, if the bound lets them reach, by shingles, which ties most copies at a cost in proportion to the sets; in
neighbourhoods that are large and still apart, further hubs follow while that ties much. Then only neighbourhoods with sets of several components are searched: their
trees find, on points alone, which are small, for each set outside the neighbourhood's largest component the sets that the
bound lets it reach and that it is not tied to. Each such pair is verified once. Where a block has many of them for a set, the
sets travel there with their shingles instead, and what the trees find is verified at once. Large neighbourhoods are cut
into blocks, and a set of the largest component meets the others alone. No candidate or partner is dropped, so the
components are exact (up to collisions of 64-bit hashes of shingles).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, durable, few, hash_words, mix64, release, shingles, slices, text_bytes, tidy
from .components import components

#: Coordinates of a point.
GROUPS = 256
#: Sets and shingles of a block of a large neighbourhood; points of a leaf of a tree; children of a box.
BLOCK_POINTS, BLOCK_SHINGLES, LEAF, FAN = 2048, 4 << 20, 32, 8
#: Candidates (of 24 bytes) that may be broadcast, and candidates of one set that one task verifies.
PAIRS_SENT, FAN_OUT = 300_000, 256
#: Pairs for a set of a block up to which they are told one by one.
PAIRS_PER_SET = 4
#: Upper end of one size class, over the end of the one before.
WIDTH = 1.5
#: Signatures that ``FREQUENT`` sets of a slice of rows share, and those that ``HOT`` sets of all kept, come last in order: the
#: ``NAMED`` most frequent of them.
FREQUENT, HOT, NAMED = 4, 10_000, 1 << 18
#: Low bits of a signature that tell its size class (modulo 64).
CLASS_BITS = 63
#: Bits of a signature above these by which sets meet (two that agree by chance make sets meet in vain, no more).
NAME_BITS = 48
#: Signatures that a task packs together, those of a bucket where sets meet, and sets that share one signature in a pack up to
#: which all of them go to its bucket.
PACK, BUCKET, TOGETHER = 1 << 21, 1 << 20, 64


def classes(limit: int = 1 << 40) -> np.ndarray:
    """First sizes of the size classes."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return np.array(out, np.int64)


_CLASSES = classes()


def differ(x: np.ndarray | int, y: np.ndarray | int, threshold: Fraction) -> np.ndarray | int:
    """Shingles in which linked sets of sizes ``x`` and ``y`` differ at most."""
    a, b = threshold.numerator, threshold.denominator
    return (b - a) * (x + y) // (a + b)


def parts_of(c: int, threshold: Fraction) -> int:
    """Parts of class ``c``: somewhat more than linked sets of it can differ in; more for small sets, where it costs nothing.
    None where too few would be full, as at low thresholds."""
    most = int(_CLASSES[c + 1]) - 1
    d = int(differ(most, most, threshold))
    m = max(d + d // 6 + 3, min(2 * most, 16))
    return m if m * (1 - np.exp(-most / m)) > d else 0


def signatures(h: np.ndarray, row: np.ndarray, rows: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, its row) of distinct shingles, and (row, class, signatures that it may leave out).

    Sets of sizes that can be linked meet in the class of the larger; a set is in all classes where its larger partners are."""
    size = np.bincount(row, minlength=rows)
    own = np.searchsorted(_CLASSES, size, "right") - 1
    share = mix64(h + U64(0x9E3779B97F4A7C15))
    deal = (h >> U64(11)).astype(np.int64)
    largest = size * threshold.denominator // threshold.numerator
    reach = np.searchsorted(_CLASSES, largest, "right") - 1
    some = size > 0
    out: list[list[np.ndarray]] = [[], [], [], [], []]

    def send(s: np.ndarray, at: np.ndarray, c: int) -> None:
        out[0].append((mix64(s) & ~U64(CLASS_BITS)) | U64(c & CLASS_BITS))
        out[1].append(at)

    for c in range(int(own[some].min()), int(reach[some].max()) + 1) if some.any() else ():
        mine = np.flatnonzero(some & (own <= c) & (c <= reach))
        if not len(mine):
            continue
        full_parts = np.zeros(len(mine), np.int64)
        if m := parts_of(c, threshold):
            index = np.full(rows, -1)
            index[mine] = np.arange(len(mine))
            take = index[row] >= 0
            slot = index[row[take]] * m + deal[take] % m
            n = len(mine) * m
            low = np.bincount(slot, (share[take] & U64(0xFFFFFFFF)).astype(np.float64), n).astype(U64)
            high = np.bincount(slot, (share[take] >> U64(32)).astype(np.float64), n).astype(U64)
            full = np.flatnonzero(np.bincount(slot, minlength=n))
            send(mix64((high[full] << U64(32)) + low[full]) + mix64((full % m).astype(U64) + U64(c << 32)), mine[full // m], c)
            full_parts = np.bincount(full // m, minlength=len(mine))
        spare = full_parts - differ(size[mine], np.minimum(largest[mine], _CLASSES[c + 1] - 1), threshold)
        out[2].append(mine)
        out[3].append(np.full(len(mine), c & CLASS_BITS))
        out[4].append(np.maximum(spare - 1, 0))
        few = mine[spare < 1]
        if len(few):
            lacks = np.zeros(rows, bool)
            lacks[few] = True
            own_h, at = share[lacks[row]], row[lacks[row]]
            order = np.lexsort((own_h, at))
            own_h, at = own_h[order], at[order]
            # At least threshold x size of its shingles are common: one of any size - that + 1.
            first = np.arange(len(at)) - np.searchsorted(at, at)
            kept = first <= size[at] - -(-size[at] * threshold.numerator // threshold.denominator)
            send(own_h[kept] + U64(0x5851F42D4C957F2D + (c << 32)), at[kept], c)
    types = (U64, np.int64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True))


def distinct_shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, in order of row and hash; A-Z are lower-cased."""
    words, at = hash_words(data, off, lower=True)
    h, row = shingles(words, at, n, len(off) - 1)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))


def shingle_sets(named: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """``key``, ``same``, ``n_shingles``, ``n_parts``, ``point`` (counts by group, 16 bits each, at most 65535), ``parts`` (names of all
    signatures, ``NAME_BITS`` each, class by class), ``widths`` and ``spare`` (of each class: how many signatures, and how many of
    them may be left out) of rows ``key``, ``same``, ``text``; and ``often`` and ``times``, in one row of each slice of rows: the names
    that ``FREQUENT`` sets of it share, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = b.num_rows
            h, row = distinct_shingles(*text_bytes(b.column("text")), n)
            s, at, of, cls, spare = signatures(h, row, rows, threshold)
            own = at << 6 | (s & U64(CLASS_BITS)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            own, name = own[order], s[order] >> U64(6) & U64((1 << NAME_BITS) - 1)
            order = np.lexsort((cls, of))
            of, group, spare = of[order], (of << 6 | cls)[order], spare[order]
            widths = np.searchsorted(own, group, "right") - np.searchsorted(own, group)
            often, times = np.unique(name, return_counts=True)
            often, times = often[times >= FREQUENT], times[times >= FREQUENT]
            first = np.zeros(len(often), np.int64)
            slot = row * GROUPS + (h & U64(GROUPS - 1)).astype(np.int64)
            points = np.minimum(np.bincount(slot, minlength=rows * GROUPS), 65535).astype("<u2")
            point = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * GROUPS), rows, [None, pa.py_buffer(points.tobytes())]).cast(pa.binary())
            n_parts = np.bincount(at, minlength=rows)
            ends = np.concatenate([[0], np.cumsum(n_parts)]) * (NAME_BITS // 8)
            packed = name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : NAME_BITS // 8].tobytes()
            parts = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
            lists = (_lists(widths, of, rows), _lists(spare, of, rows), _lists(often.view(np.int64), first, rows), _lists(times, first, rows))
            counts = (pa.array(np.bincount(row, minlength=rows), pa.int64()), pa.array(n_parts, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("same"), *counts, point, parts, *lists], ["key", "same", "n_shingles", "n_parts", "point", "parts", "widths", "spare", "often", "times"])

    arrays = ", ".join(f"{c} array<bigint>" for c in ("widths", "spare", "often", "times"))
    return named.select("key", "same", "text").mapInArrow(run, f"key bigint, same binary, n_shingles bigint, n_parts bigint, point binary, parts binary, {arrays}")


def most_frequent(counted: DataFrame) -> dict[int, int]:
    """The ``NAMED`` largest of counts (``sig``, ``n``): 4 MB at most."""
    rows = counted.orderBy(F.desc("n"), "sig").limit(NAMED).toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def kept_signatures(b: pa.RecordBatch, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, key) of what each set of ``key``, ``parts``, ``widths``, ``spare`` keeps. The order puts frequent ones (``names``, sorted, with an
    end mark, and their ``counts``) last, by how often they are; it is the same for all sets, so whatever it is, linked sets keep one
    in common."""
    parts = b.column("parts").cast(pa.large_binary())
    off = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + b.num_rows + 1]
    size = NAME_BITS // 8
    raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].reshape(-1, size)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :size] = raw
    name, row = wide.view("<u8").ravel().astype(U64), np.repeat(np.arange(b.num_rows), np.diff(off) // size)
    widths = b.column("widths").flatten().to_numpy()
    group = np.repeat(np.arange(len(widths)), widths)
    place = np.searchsorted(names, name)
    times = np.where(names[place] == name, counts[place], 0)
    at = np.lexsort((name, times, group))
    # Where a set's signatures of a class end, and how many before that end may go.
    end = (np.cumsum(widths) - b.column("spare").flatten().to_numpy())[group]
    keep = at[np.arange(len(at)) < end]
    return name[keep], b.column("key").to_numpy()[row[keep]]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next, as many as the largest has."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes, n: int) -> np.ndarray:
    by_byte = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(by_byte)] = by_byte.T
    return out.view("<u8").ravel().astype(U64)


def meeting(sets: DataFrame, frequent: dict[int, int]) -> DataFrame:
    """(``sig``, ``rep``, ``hub``, ``n``): the sets that keep a signature which several keep, the smallest of them and their number.

    Tasks pack what their sets keep, sorted by name, and deal it to buckets by ranges of names, where all sets of a name meet. Of a
    name that more than ``TOGETHER`` sets of a pack keep, the smallest goes to its bucket; these sets are told one by one
    beside it, in rows without ``hub`` and ``n``, by tasks that have nothing to do with the name."""
    names = np.array(sorted(frequent), np.int64)
    names, counts = np.append(names, 1 << NAME_BITS).astype(U64), np.array([*(frequent[x] for x in names.tolist()), 0], np.int64)
    rows = sets.where("key is not null").select("key", "n_parts", "parts", "widths", "spare")
    total = rows.agg(F.coalesce(F.sum("n_parts"), F.lit(0))).first()[0]
    buckets = min(1 << (63 - NAME_BITS), max(4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def messages() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            name, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(name)
            name, rep = name[order], rep[order]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(name)))
            many = np.repeat(times > TOGETHER, times)
            out = []
            for k in range(0, int(many.sum()), 1 << 16):
                out.append((buckets + turn % buckets, name[many][k : k + (1 << 16)], rep[many][k : k + (1 << 16)]))
                turn += 1
            if many.any():
                rep[starts] = np.where(times > TOGETHER, np.minimum.reduceat(rep, starts), rep[starts])
                many[starts] = False
                name, rep = name[~many], rep[~many]
            to = (name * U64(buckets) >> U64(NAME_BITS)).astype(np.int64)
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            out += [(int(to[x]), name[x:y], rep[x:y]) for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True) if y > x]
            for k in range(0, len(out), 64):
                columns = zip(*((to, len(x), int(x[0]), int(y.min()), planes(np.diff(x, prepend=x[:1])), planes(y.astype(U64) - y.min().astype(U64))) for to, x, y in out[k : k + 64]), strict=True)
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "n", "name", "rep", "names", "reps"])

        waiting = 0
        for b in (x.slice(k, 512) for x in batches for k in range(0, x.num_rows, 512)):
            held.append(kept_signatures(b, names, counts))
            waiting += len(held[-1][0])
            if waiting >= PACK:
                yield from messages()
                waiting = 0
        if held:
            yield from messages()
        tidy()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            name, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if last >= buckets:
                none = pa.nulls(len(name), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rep), none, none], ["sig", "rep", "hub", "n"])
            order = np.argsort(name, kind="stable")  # of sorted runs
            name = name[order]
            like = name[1:] == name[:-1]
            some = np.flatnonzero(np.concatenate([[False], like]) | np.concatenate([like, [False]]))
            name, rep = name[some], rep[order[some]]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(name)))
            hub = np.repeat(np.minimum.reduceat(rep, starts), times) if len(name) else rep
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), rep, hub, np.repeat(times, times))], ["sig", "rep", "hub", "n"])

        for batch in batches:
            for bucket, n, first, least, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bucket != last:
                    yield told()
                last = bucket
                held.append((np.cumsum(from_planes(x, n)) + U64(first), (from_planes(y, n) + np.int64(least).astype(U64)).view(np.int64)))
        if held:
            yield told()
        tidy()

    packed = rows.drop("n_parts").mapInArrow(pack, "bucket int, n int, name bigint, rep bigint, names binary, reps binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "sig bigint, rep bigint, hub bigint, n bigint")


class RTree:
    """Boxes over points, packed in order of size and then of the points' first coordinates, ``FAN`` to a box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:3], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(points), LEAF)
        upper = np.maximum.reduceat(self.points, starts) if len(points) else self.points
        low, high = self.sizes[starts], self.sizes[np.minimum(starts + LEAF, len(points)) - 1]
        self.levels = [(upper, low, high)]
        while len(self.levels[-1][0]) > FAN:
            upper, low, high = self.levels[-1]
            starts = np.arange(0, len(upper), FAN)
            self.levels.append((np.maximum.reduceat(upper, starts), low[starts], np.maximum.reduceat(high, starts)))

    @staticmethod
    def may(points: np.ndarray, low: np.ndarray, high: np.ndarray, p: np.ndarray, size: int, t: Fraction) -> np.ndarray:
        """Can a set at such a point, or in a box with such an upper corner and sizes, reach the threshold with (p, size)?

        A set with n shingles of which c are common reaches it if c * (1 + t) >= t * (n + size); the bound on c is the sum
        of the smaller counts, and n is at least c, and at least what the box has."""
        least = np.minimum(points, p)
        bound = least.sum(1, dtype=np.int64)
        if p.max(initial=0) >= 65535:  # a count that stopped there may be larger
            bound[(least >= 65535).any(1)] = 1 << 60
        bound = np.minimum(bound, np.minimum(high, size))
        a, b = t.numerator, t.denominator
        return bound * (a + b) >= a * (np.maximum(low, bound) + size)

    def search(self, p: np.ndarray, size: int, t: Fraction, open_: np.ndarray) -> np.ndarray:
        """Places (in the tree's order) of the open points whose bound reaches the threshold."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(upper)]
            at = at[self.may(upper[at], low[at], high[at], p, size, t)]
            if not len(at):
                return at
        at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        at = at[open_[at]]
        return at[self.may(self.points[at], self.sizes[at], self.sizes[at], p, size, t)]


def reaches(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    """Do two sets of distinct shingles reach the threshold?"""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return bool(common) and common * t.denominator >= t.numerator * (len(x) + len(y) - common)


def block_links(keys: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], side: np.ndarray, inner: bool, t: Fraction) -> list[tuple[int, int]]:
    """Verified links that tie all that is linked among the sets of a block, of those with different labels.

    Sets of side 1 search the tree of all for sets of side 0, and of side 1 too if ``inner``. What the trees find is verified at
    once, and what that ties is no longer searched for, so there is a link less than there are labels at most."""
    if len(np.unique(labels)) < 2:
        return []
    if len(keys) == 2:
        may = inner if side[0] == side[1] == 1 else side[0] != side[1]
        return [(int(min(keys)), int(max(keys)))] if may and reaches(sets[0], sets[1], t) else []
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    slot = np.repeat(np.arange(len(sets)), sizes) * GROUPS + (every & U64(GROUPS - 1)).astype(np.int64)
    points = np.bincount(slot, minlength=len(sets) * GROUPS).reshape(-1, GROUPS)
    tree = RTree(np.minimum(points, 65535).astype(np.uint16), sizes)
    place = tree.order
    side = side[place]
    root = np.unique(labels, return_inverse=True)[1][place]
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(side == 1):
        open_ = root != root[k]
        if not inner:
            open_ &= side == 0
        if not open_.any():
            continue
        for f in tree.search(tree.points[k], int(tree.sizes[k]), t, open_).tolist():
            if root[f] != root[k] and reaches(sets[place[k]], sets[place[f]], t):
                root[root == root[f]] = root[k]
                a, b = int(keys[place[k]]), int(keys[place[f]])
                out.append((min(a, b), max(a, b)))
    return out


def block_partners(labels: np.ndarray, sizes: np.ndarray, points: np.ndarray, side: np.ndarray, inner: bool, t: Fraction) -> tuple[np.ndarray, list[tuple[int, int]] | None]:
    """Which sets of a block have a partner of another label that the bound lets them reach, and these pairs, or None where they
    are more than ``PAIRS_PER_SET`` for a set; sides as in ``block_links``."""
    out = np.zeros(len(labels), bool)
    pairs: list[tuple[int, int]] | None = []
    if len(np.unique(labels)) < 2:
        return out, pairs
    tree = RTree(points, sizes)
    labels, side = labels[tree.order], side[tree.order]
    for k in np.flatnonzero(side == 1):
        open_ = labels != labels[k] if inner else (labels != labels[k]) & (side == 0)
        if open_.any() and len(found := tree.search(tree.points[k], int(tree.sizes[k]), t, open_)):
            out[tree.order[found]] = out[tree.order[k]] = True
            if pairs is not None:
                pairs += [(int(tree.order[k]), f) for f in tree.order[found].tolist()]
                if len(pairs) > PAIRS_PER_SET * len(labels):
                    pairs = None
    return out, pairs


def beside(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Rows ``a``, ``salt``, ``b``, ``what``, in order, of ``pairs``: what ``own`` (``key``, ``what``) has of ``a``, with null as ``b``, for each ``FAN_OUT`` of its
    pairs, and then of the ``b`` of each of these.

    What belongs to the pairs' ends, and nothing else, moves. The pairs find it by a broadcast while they are few, else by a join."""
    small = pairs.count() <= PAIRS_SENT
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN_OUT).cast("int").alias("salts"))
    wanted = pairs.join(salts, "a").select(F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    wanted = wanted.unionByName(salts.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b")))
    rows = own.join(F.broadcast(wanted) if small else wanted, "key").select("a", "salt", "b", "what")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))


def told_pairs(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        x, y = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def split_points(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, points) of what ``points`` tables hold."""
    both = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return both[:, :8].copy().view(">i8").ravel().astype(np.int64), both[:, 8:].copy().view("<u2")


def within_bound(pairs: DataFrame, points: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``a``, ``b`` that the bound on their points lets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, point = 0, np.zeros(0, np.uint16)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            sizes, every = split_points(batch.column(3).to_pylist())
            ends = [k for k in range(len(b)) if b[k] is None]
            out: list[tuple[int, int]] = []
            for x, y in zip([0, *ends], [*ends, len(b)], strict=True):
                if y > x and b[x] is None:
                    size, point, x = int(sizes[x]), every[x], x + 1
                if y > x:
                    may = RTree.may(every[x:y], sizes[x:y], sizes[x:y], point, size, threshold)
                    out += [(a[x + k], b[x + k]) for k in np.flatnonzero(may).tolist()]
            yield from told_pairs(out)
        tidy()

    return beside(pairs, points.select(F.col("rep").alias("key"), F.col("point").alias("what"))).mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, named: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """The pairs ``a``, ``b`` that are linked, by the shingles of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, U64)
        for batch in slices(batches, "what"):
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            h, row = distinct_shingles(*text_bytes(batch.column(3)), n)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                mine = h[ends[k] : ends[k + 1]]
                if b[k] is None:
                    held = mine
                elif reaches(held, mine, threshold):
                    out.append((a[k], b[k]))
            yield from told_pairs(out)

    return beside(pairs, named.select("key", F.col("text").alias("what"))).mapInArrow(run, "a bigint, b bigint")


def neighbourhoods(sets: DataFrame) -> DataFrame:
    """(``hub``, ``rep``), ``hub`` < ``rep``: for each signature that a set kept, the smallest set that kept it too. ``sets`` are
    deleted once it is known where their signatures meet."""
    slices_ = sets.select(F.explode(F.arrays_zip("often", "times")).alias("e")).groupBy(F.col("e.often").alias("sig")).agg(F.sum("e.times").alias("n"))
    frequent = most_frequent(slices_)
    tried = set(frequent)
    while True:
        met = durable(meeting(sets, frequent), "met")
        # What turned out to be hot, and was not known to be, is put last too, and sets choose again.
        hot = most_frequent(met.where(F.col("n").isNull() | (F.col("n") > HOT)).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
        if not set(hot) - tried:
            break
        tried |= set(hot)
        frequent = dict(sorted((frequent | hot).items(), key=lambda x: (-x[1], x[0]))[:NAMED])
        release(met)
    release(sets)
    pairs = met.select("hub", "rep")
    apart_ = met.where("hub is null").select("sig", "rep")
    if not apart_.isEmpty():
        # What was told one by one; Spark can split the join, as a signature has one hub here.
        hubs = met.join(apart_.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("rep").alias("hub"))
        pairs = pairs.unionByName(apart_.join(hubs, "sig").select("hub", "rep"))
    out = durable(pairs.where("hub <> rep").distinct(), "hoods")
    release(met)
    return out


def apart(hoods: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the neighbourhoods that hold several components: ``hub``, ``rep``, ``label``, ``size``, ``main`` (of the largest
    of these components), and in how many blocks (``mains``, ``rests``) those of it and the others are dealt."""
    own = hoods.select("hub", F.col("hub").alias("rep")).distinct()
    rows = hoods.unionByName(own).join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = rows.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("hub")
    rows = durable(rows.join(several, "hub", "left_semi").join(sizes, "rep"), "apart")
    by_label = rows.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    of = by_label.groupBy("hub").agg(F.max(F.struct("n", "s", F.col("label").alias("best"))).alias("m"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_POINTS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    of = of.select("hub", "m.best", blocks(F.col("m.n"), F.col("m.s")).alias("mains"), blocks(F.col("all_n") - F.col("m.n"), F.col("all_s") - F.col("m.s")).alias("rests"))
    out = durable(rows.join(of, "hub").withColumn("main", F.col("label") == F.col("best")).drop("best"), "apart")
    release(rows)
    return out


def dealt(rows: DataFrame, own: DataFrame, what: str) -> DataFrame:
    """The rows of ``apart`` in the blocks where they meet (``hub``, ``kind``, ``i``, ``j``, ``side``, ``rep``, ``label``), with what
    ``own`` (``rep``, and the column ``what``) has of each set."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    span = lambda top: F.explode(F.sequence(F.lit(0), F.col(top) - 1))
    # Blocks of the largest component (i) with blocks of the others (j); the others among themselves, block by block.
    mixed = rows.where("main").withColumn("j", span("rests")).select("hub", F.lit(1).alias("kind"), F.col("own").alias("i"), "j", F.lit(0).alias("side"), "rep", "label")
    mixed = mixed.unionByName(rows.where("not main").withColumn("i", span("mains")).select("hub", F.lit(1).alias("kind"), "i", F.col("own").alias("j"), F.lit(1).alias("side"), "rep", "label"))
    among = rows.where("not main and rests > 1").withColumn("other", span("rests")).where("other <> own")
    among = among.select("hub", F.lit(0).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "label")
    both = mixed.unionByName(among).join(own, "rep").select("hub", "kind", "i", "j", "side", "rep", "label", what)
    # Many small neighbourhoods share a task and a batch: they are told apart in order, not by a call for each.
    return both.repartition("hub", "kind", "i", "j").sortWithinPartitions("hub", "kind", "i", "j", "rep")


def in_blocks(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """``solve`` (hub, side, rep, label, raw, inner) of each whole block of sorted rows, as batches of what it tells: ``a``, ``b`` (and ``dense``)."""
    last: tuple[int, ...] | None = None
    held: list[tuple[int, int, int, bytes]] = []
    out: list[tuple[int, ...]] = []

    def finish() -> None:
        if len(held) > 1:
            side, rep, label = (np.array([x[k] for x in held], np.int64) for k in range(3))
            # Of two blocks one searches and the other is found; a block that stands alone is searched inside too.
            out.extend(solve(last[0], side, rep, label, [x[3] for x in held], last[1] == 1 and last[2] == 0))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "dense"][: len(columns)])

    for batch in batches:
        where = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        side, rep, label = (batch.column(k).to_pylist() for k in (4, 5, 6))
        for k, at in enumerate(where):
            if at != last:
                finish()
                last, held = at, []
            held.append((side[k], rep[k], label[k], batch.column(7)[k].as_py()))
        if out:
            yield batch_of()
            out.clear()
    finish()
    if out:
        yield batch_of()
    held.clear()
    tidy()


def with_partners(rows: DataFrame, points: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """What the trees of the blocks of ``apart`` find on points alone: the pairs ``a``, ``b`` of different components that the bound lets
    reach each other, each once; and, of blocks with many pairs for a set, the rows of the sets that have partners."""

    def solve(hub: int, side: np.ndarray, rep: np.ndarray, label: np.ndarray, raw: list[bytes], inner: bool) -> list[tuple[int, int]]:
        sizes, point = split_points(raw)
        some, pairs = block_partners(label, sizes, point, side, inner, threshold)
        if pairs is None:
            return [(hub, int(r), 1) for r in rep[some]]
        return [(int(min(rep[x], rep[y])), int(max(rep[x], rep[y])), 0) for x, y in pairs]

    found = durable(dealt(rows, points, "point").mapInArrow(lambda batches: in_blocks(batches, solve), "a bigint, b bigint, dense bigint").distinct(), "partners")
    dense = found.where("dense = 1").select(F.col("a").alias("hub"), F.col("b").alias("rep"))
    return found.where("dense = 0").select("a", "b"), durable(rows.join(dense, ["hub", "rep"], "left_semi"), "apart")


def search_blocks(rows: DataFrame, named: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Links ``a``, ``b`` between components of the neighbourhoods of ``rows`` (of ``apart``), by the trees of their blocks."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, row = distinct_shingles(*text_bytes(b.column("text")), n)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]) * 8
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())], ["rep", "shingles"])

    def solve(hub: int, side: np.ndarray, rep: np.ndarray, label: np.ndarray, raw: list[bytes], inner: bool) -> list[tuple[int, int]]:
        return block_links(rep, label, [np.frombuffer(x, U64) for x in raw], side, inner, threshold)

    needed = durable(rows.select(F.col("rep").alias("key")).distinct(), "needed")
    sets = durable(named.join(few(needed), "key", "left_semi").select("key", "text").mapInArrow(to_sets, "rep bigint, shingles binary"), "shingles")
    links = durable(dealt(rows, sets, "shingles").mapInArrow(lambda batches: in_blocks(batches, solve), "a bigint, b bigint").distinct(), "links")
    release(sets, needed)
    return links


def by_row(docs: DataFrame, n: int, threshold: Fraction, text: str, key: str) -> DataFrame:
    """``jaccard_components`` where rows that repeat a key differ in their texts, or keys are no whole numbers: rows are told
    apart by numbers, and each component gets its smallest key at the end."""
    number = F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())
    rows = durable(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), number.alias("row")), "rows")
    found = durable(jaccard_components(rows.select("row", "text"), n, threshold, "text", "row"), "by-row")
    named = found.where("row is not null").join(rows.select("row", "key"), "row")
    least = named.groupBy("component_id").agg(F.min("key").alias("least"))
    out = named.join(least, "component_id").select(F.col("key").alias(key), "n_shingles", F.col("least").alias("component_id"))
    none = F.lit(None).cast(docs.schema[key].dataType)
    return out.unionByName(found.where("row is null").select(none.alias(key), "n_shingles", none.alias("component_id")))


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Components of documents whose sets of ``n``-word shingles reach a Jaccard similarity of ``threshold``.

    Returns one row per document: ``key``, ``n_shingles`` long (set size), ``component_id`` (the smallest key reachable by
    links, itself included). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document with fewer words than
    ``n`` has its whole sequence as its one shingle; one without words, or whose text is null, links with nothing. Rows
    that repeat a key are kept, each with its own text; a null key links with nothing. Keys may be of any type that has an
    order. An empty table has no rows. Other columns are left out.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return by_row(docs, n, threshold, text, key)
    named = docs.select(F.col(key).cast("bigint").alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("same"), F.col(text).alias("text"))
    # Equal texts are one: their smallest key stands for them.
    features = durable(named.select("key", "same"), "features")
    if not features.where("key is not null").groupBy("key").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").isEmpty():
        # A key that has several texts cannot stand for one: its rows get numbers.
        release(features)
        return by_row(docs, n, threshold, text, key)
    # Rows of one key and text, and rows without a key of one text, are one from here on; usually there are none.
    twice = durable(features.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "same"), "twice")
    first = features.where("key is not null").groupBy("same").agg(F.min("key").alias("rep"))
    gone = durable(features.join(first, "same").where("key <> rep").select("key").distinct(), "gone")
    chosen = named
    if not twice.isEmpty():
        several = few(twice)
        same = named["key"].eqNullSafe(several["key"]) & (named["same"] == several["same"])
        chosen = named.join(several, same, "left_anti").unionByName(named.join(several, same, "left_semi").dropDuplicates(["key", "same"]))
    texts = chosen.where("key is not null").select("key", "text")
    sets = durable(shingle_sets(chosen.join(few(gone), "key", "left_anti"), n, threshold), "sets")
    sizes = durable(sets.select("key", "same", "n_shingles"), "sizes")
    whole = F.concat(F.unhex(F.lpad(F.hex("n_shingles"), 16, "0")), "point").alias("point")
    points = durable(sets.where("key is not null").select(F.col("key").alias("rep"), whole), "points")
    hoods = neighbourhoods(sets)
    release(gone)
    found: list[DataFrame] = []

    def tie(links: DataFrame) -> DataFrame:
        """Labels by all links so far."""
        found.append(links)
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return durable(components(every).select(F.col("node").alias("rep"), F.col("component").alias("label")), "labels")

    def compared(stars: DataFrame) -> DataFrame:
        """The links among pairs with hubs; texts move only for those that the bound lets reach each other."""
        may = durable(within_bound(stars, points, threshold), "may")
        links = durable(verify(may, texts, n, threshold), "links")
        release(may)
        return links

    labels = None
    if not hoods.isEmpty():
        one = durable(hoods.groupBy("rep").agg(F.min("hub").alias("a")).select("a", F.col("rep").alias("b")), "stars")
        labels = tie(compared(one))
        release(one)
        of_size = sizes.where("key is not null").select(F.col("key").alias("rep"), F.col("n_shingles").alias("size")).dropDuplicates(["rep"])
        left = None
        while True:
            rows = apart(hoods, labels, of_size)
            # In large neighbourhoods that are still apart, another set is tried as a hub, while that ties much of them.
            large = rows.where("not main and rests > 1")
            now = large.count()
            if not now or left is not None and now > left * 0.9:
                break
            left = now
            pivot = large.groupBy("hub").agg(F.min_by("rep", F.xxhash64("rep", F.lit(now))).alias("a"))
            stars = durable(large.join(pivot, "hub").where("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "stars")
            before, labels = labels, tie(compared(stars))
            release(stars, before, rows)
        pairs, left_over = with_partners(rows, points, threshold)
        if not pairs.isEmpty():
            before, labels = labels, tie(durable(verify(pairs, texts, n, threshold), "links"))
            release(before)
        if not left_over.isEmpty():
            before, labels = labels, tie(search_blocks(left_over, texts, n, threshold))
            release(before)
        release(rows, left_over, *found)
    release(hoods, points)
    by_text = sizes.groupBy("same").agg(F.max("n_shingles").alias("n_shingles"), F.min("key").alias("rep"))
    answer = features.join(by_text, "same")
    if labels is not None:
        answer = answer.join(labels, "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
    component = F.when(F.col("key").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("key")))
    kind = docs.schema[key].dataType
    return answer.select(F.col("key").cast(kind).alias(key), "n_shingles", component.cast(kind).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without all but one of each component: the one with the smallest key stays. Of rows that repeat a
    key one stays; rows with a null key stay."""
    found = durable(jaccard_components(docs, n, threshold, text, key), "near")
    gone = durable(found.where(F.col("component_id") < F.col(key)).select(key).distinct(), "gone")
    kept = docs.join(few(gone), key, "left_anti").select(*docs.columns)
    twice = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    if twice.isEmpty():  # texts need not be moved to find repeated keys
        return kept
    once = kept.join(twice, key, "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(twice, key, "left_semi").select(*docs.columns).dropDuplicates([key]))
