"""Repeated passages by a sparse suffix array.

Of all suffixes (at words) only those are kept that begin at minimisers: positions whose hash of the next ``GRAM`` words is
the smallest in some window of such hashes. The choice depends on the words alone, and every passage of ``least`` words
holds one with its ``GRAM`` words, so two copies of a passage keep suffixes at the same places in it. Suffixes whose first
words occur once are dropped. The others are sorted as a whole (a range partitioning of suffix, left context, document and
place, so no frequent passage meets in one task); neighbours are compared, and their matches extended to the right and to
the left. Where both together reach ``least`` words, a passage repeats. As minimisers are never further apart than their
window, contexts of a window's length on both sides are enough.

Where three suffixes or more begin with the same words, two that share a passage need not be neighbours: others with another
left context can stand between them. There each window of ``least`` words around a minimiser gets a key, and equal keys are
found in a second sort. A window belongs to the first of its smallest hashes, so equal windows meet under one key. Windows are
left out only where the first sort settles them: no other suffix has the words on the right, or a neighbour at a smaller
document or place has the window too. So the matches cover all of each passage.

Which copy stays: in a run of neighbours that match, each suffix has what the run's first (smallest document and place) and
it have in common, which is what all neighbours between them share. Only what is known to stand at a smaller document or
place is removed, so of each passage a copy stays. Each span that can go names the place of its copy; sorted suffixes hold
31 bits of each word, so before a span counts as one that can go, the bytes of its words and of its copy's are compared by a
128-bit digest.

A document is a row, not a key: where rows that repeat a key have different texts, or keys are no whole numbers, rows get
numbers in order of their keys (``identified``), and spans belong to the row whose text gave them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U64, durable, few, hash_words, mix64, release, slices, text_bytes, tidy, word_spans

#: Words that a suffix's key is made of.
GRAM = 16


def window_of(least: int) -> int:
    """Hashes of a minimiser window, so that every passage of ``least`` words has a whole one."""
    if least < GRAM + 2:
        raise ValueError(f"passages of {GRAM + 2} words at least")
    return least - GRAM + 1


def sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """Minimum or maximum of each run of ``w`` values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each run of ``GRAM`` words."""
    n = max(0, len(words) - GRAM + 1)
    h = words[:n].copy()
    for k in range(1, GRAM):
        h = h * U64(0xC2B2AE3D27D4EB4F) + words[k : n + k]
    return mix64(h)


def minimisers(words: np.ndarray, row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the word) of the selected suffixes."""
    n = len(words) - GRAM + 1
    if n < w:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = gram_hashes(words)
    # Windows stay within a document; others count as having the smallest minimum, and select nothing.
    low = sliding(h, w, np.minimum)
    low[row[: len(low)] != row[w + GRAM - 2 : w + GRAM - 2 + len(low)]] = 0
    pad = np.zeros(w - 1, U64)
    high = sliding(np.concatenate([pad, low, pad]), w, np.maximum)[:n]
    at = np.flatnonzero((high == h) & (h > 0))
    return h[at], at


def identified(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(``doc``, ``text``) of the documents that have a key, each once, and (``doc``, ``key``, ``same``), which tells what a number stands
    for, or None if keys are the numbers. ``same`` is a digest of the text. Rows of one key and text are one document."""
    same = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), same.alias("same"), F.col(text).alias("text"))
    order = ["key", "same"]
    counts = durable(named.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), "rows")
    twice = durable(counts.where("n > 1").select(*order), "twice")
    if not twice.isEmpty():
        again = [named["key"] == twice["key"], named["same"] == twice["same"]]
        named = named.join(few(twice), again, "left_anti").unionByName(named.join(few(twice), again, "left_semi").dropDuplicates(order))
    if isinstance(docs.schema[key].dataType, T.IntegralType) and counts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        return named.select(F.col("key").cast("bigint").alias("doc"), "text"), None
    names = counts.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    names = durable(names.withColumn("doc", F.monotonically_increasing_id()), "names")
    return named.join(names, order).select("doc", "text"), names


def suffix_keys(source: DataFrame, least: int) -> DataFrame:
    """(``gram``, ``doc``, ``pos``) of the selected suffixes of all documents."""
    w = window_of(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, row = hash_words(*text_bytes(b.column("text")))
            if not len(words):
                continue
            g, at = minimisers(words, row, w)
            begin = np.searchsorted(row, np.arange(b.num_rows))
            doc = b.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc[row[at]]), pa.array((at - begin[row[at]]).astype(np.int32))], ["gram", "doc", "pos"])

    return source.mapInArrow(run, "gram bigint, doc bigint, pos int")


def asked_of(source: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents with what is ``asked`` of each (``doc``, ``at``). Texts of which nothing is asked are left out before any are moved,
    as long as the others' numbers can be sent to all tasks."""
    return source.join(few(asked.select("doc")), "doc", "left_semi").join(asked, "doc").select("doc", "text", "at")


def contexts(source: DataFrame, least: int) -> DataFrame:
    """(``gram``, ``tail``, ``head``, ``doc``, ``pos``, ``low``, ``high``) of the suffixes at the places ``at`` (an array of ``gram`` and ``pos``) of
    documents: hashes of the words after the key, and of those before it from the nearest on. Big-endian, so that
    they sort as the words do; where a text ends there are zeros, which no word has. The windows that belong to a suffix
    begin ``low`` to ``high`` words before it."""
    w = window_of(least)
    right, left = least - GRAM, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, row = hash_words(*text_bytes(b.column("text")))
            short = (words >> U64(32)).astype(np.uint32) | np.uint32(1)
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            at = b.column("at").flatten() if b.column("at").null_count == 0 else b.column("at").drop_null().flatten()
            count = np.diff(b.column("at").offsets.to_numpy())
            gram, pos = at.field(0).to_numpy(), at.field(1).to_numpy().astype(np.int64)
            of = np.repeat(np.arange(b.num_rows), count)
            doc = b.column("doc").to_numpy()
            padded = np.concatenate([np.zeros(left, np.uint32), short, np.zeros(least, np.uint32)])
            most = U64(0xFFFFFFFFFFFFFFFF)
            hashes = np.concatenate([np.full(left, most, U64), gram_hashes(words), np.full(least, most, U64)])
            for s in range(0, len(pos), 20_000):
                p, o = pos[s : s + 20_000], of[s : s + 20_000]
                place = begin[o] + p
                after = place[:, None] + GRAM + np.arange(right)
                tail = np.where(after < begin[o + 1][:, None], padded[after + left], 0).astype(">u4")
                before = place[:, None] - 1 - np.arange(left)
                head = np.where(before >= begin[o][:, None], padded[before + left], 0).astype(">u4")
                own = hashes[place + left][:, None]
                # The nearest gram before that is as small, and the nearest after that is smaller, bound the windows.
                smaller = hashes[before[:, : w - 1] + left] <= own
                high = np.minimum(np.where(smaller.any(1), smaller.argmax(1), w - 1), p)
                smaller = hashes[place[:, None] + 1 + np.arange(w - 1) + left] < own
                low = np.where(smaller.any(1), w - 1 - smaller.argmax(1), 0)
                as_binary = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(gram[s : s + 20_000]), as_binary(tail), as_binary(head), pa.array(doc[o]), pa.array(p.astype(np.int32)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16))], ["gram", "tail", "head", "doc", "pos", "low", "high"])

    return source.select("doc", "text", "at").mapInArrow(run, "gram bigint, tail binary, head binary, doc bigint, pos int, low smallint, high smallint")


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    col = col.cast(pa.large_binary())
    start = np.frombuffer(col.buffers()[1], np.int64)[col.offset] // 4
    return np.frombuffer(col.buffers()[2], ">u4")[start : start + len(col) * width].reshape(len(col), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows have in common from the first on."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


#: What the comparison returns: spans of words that repeat, spans that can go, the ends of each sorted part, and windows to
#: look at again.
REPEAT, REMOVE, EDGE, WINDOW = 0, 1, 2, 3
_SCHEMA = "kind int, doc bigint, start int, stop int, copy bigint, copy_start int, gram bigint, tail binary, head binary, pos int, place int, first_doc bigint, first_pos int, path_right int, path_left int, whole boolean, window bigint"


def open_windows(least: int, gram, tail, head, pos, low, high, right, left, ok, later) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, key) of the windows of a batch of sorted suffixes that comparing neighbours does not settle. ``right``,
    ``left``, ``ok`` and ``later`` are of the pair of each row and the one before it. What lies outside the batch is not known
    here, so rows near its ends count as if others stood there."""
    n, w = len(gram), window_of(least)
    edge = np.ones(n, bool)
    edge[2:-2] = False
    several = edge.copy()
    several[2:] |= gram[2:] == gram[:-2]
    several[:-2] |= gram[2:] == gram[:-2]
    several[1:-1] |= (gram[1:-1] == gram[:-2]) & (gram[1:-1] == gram[2:])
    # Suffixes are sorted by what follows, so no other has more of it than a neighbour.
    nearest = right.copy()
    nearest[:-1] = np.maximum(nearest[:-1], right[1:])
    nearest[edge] = GRAM + _common(tail[edge], tail[edge])
    low, high = np.maximum(low, least - nearest), high.astype(np.int64)
    count = np.where(several, np.maximum(high - low + 1, 0), 0)
    of = np.repeat(np.arange(n), count)
    j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
    gone = (ok & later)[of] & (j >= least - right[of]) & (j <= left[of])
    after = np.append(ok[1:] & ~later[1:], False)
    r_next, l_next = np.append(right[1:], 0), np.append(left[1:], 0)
    gone |= after[of] & (j >= least - r_next[of]) & (j <= l_next[of])
    of, j = of[~gone], j[~gone]
    rows, of_row = np.unique(of, return_inverse=True)
    before, behind = np.zeros((len(rows), w), U64), np.zeros((len(rows), w), U64)
    for k in range(w - 1):
        before[:, k + 1] = mix64(before[:, k] * U64(0xC2B2AE3D27D4EB4F) + head[rows, k].astype(U64))
        behind[:, k + 1] = mix64(behind[:, k] * U64(0xC2B2AE3D27D4EB4F) + tail[rows, k].astype(U64))
    key = mix64(before[of_row, j] * U64(0x9E3779B97F4A7C15) + behind[of_row, w - 1 - j] + j.astype(U64))
    return of, pos[of] - j, key.view(np.int64)


def compare(sorted_suffixes: DataFrame, least: int) -> DataFrame:
    """Spans found by comparing neighbours of each sorted part, and its two ends, for what lies across parts."""
    w = window_of(least)
    widths = (least - GRAM, w)
    names = ["kind", "doc", "start", "stop", "copy", "copy_start", "gram", "tail", "head", "pos", "place", "first_doc", "first_pos", "path_right", "path_left", "whole", "window"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, places, rights, lefts = [], [], [], []  # of all suffixes; of the pairs with the one before
        held, ends = None, []
        for b in batches:
            if not b.num_rows:
                continue
            if not ends:
                ends = [b.slice(0, 1), b.slice(0, 1)]
            ends[1] = b.slice(b.num_rows - 1)
            gram, tail, head = b.column(0).to_numpy(), _matrix(b.column(1), widths[0]), _matrix(b.column(2), widths[1])
            doc, pos, low, high = (b.column(k).to_numpy() for k in range(3, 7))
            if held is not None:
                both = [np.concatenate([x, y]) for x, y in zip(held, (gram, tail, head, doc, pos), strict=True)]
            else:
                both = [np.concatenate([x[:1], x]) for x in (gram, tail, head, doc, pos)]
            right = GRAM + _common(both[1][:-1], both[1][1:])
            left = _common(both[2][:-1], both[2][1:])
            ok = (both[0][:-1] == both[0][1:]) & (right + left >= least) & ((both[3][:-1] != both[3][1:]) | (both[4][:-1] != both[4][1:]))
            if held is None:
                ok[0] = False
            docs.append(doc), places.append(pos)
            late = (both[3][1:] > both[3][:-1]) | (both[3][1:] == both[3][:-1]) & (both[4][1:] > both[4][:-1])
            of, start, window = open_windows(least, gram, tail, head, pos, low, high, np.where(both[0][:-1] == both[0][1:], right, 0), left, ok, late)
            for s in range(0, len(of), 50_000):
                o = of[s : s + 50_000]
                part = {"kind": pa.array(np.full(len(o), WINDOW, np.int32)), "doc": pa.array(doc[o]), "start": pa.array(start[s : s + 50_000].astype(np.int32)), "gram": pa.array(gram[o]), "window": pa.array(window[s : s + 50_000])}
                yield pa.RecordBatch.from_arrays([part[c] if c in part else pa.nulls(len(o), t) for c, t in zip(names, kinds, strict=True)], names)
            rights.append(np.where(ok, right, 0).astype(np.int32)), lefts.append(np.where(ok, left, 0).astype(np.int32))
            held = [x[-1:] for x in (gram, tail, head, doc, pos)]
        if not docs:
            return
        doc, pos, right, left = (np.concatenate(x) for x in (docs, places, rights, lefts))
        n = len(doc)
        ok = right > 0
        after = np.concatenate([ok[1:], [False]])
        r_next, l_next = np.append(right[1:], np.int32(0)), np.append(left[1:], np.int32(0))
        out = []

        def spans(kind: int, index: np.ndarray, l: np.ndarray, r: np.ndarray, of: np.ndarray) -> None:
            if len(index):
                out.append((np.full(len(index), kind), doc[index], pos[index] - l, pos[index] + r, doc[of], pos[of] - l))

        some = np.flatnonzero(ok | after)
        spans(REPEAT, some, np.maximum(left, l_next)[some], np.maximum(right, r_next)[some], some)
        # What a smaller neighbour has too.
        later = np.zeros(n, bool)
        later[1:] = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (pos[1:] > pos[:-1])
        at = np.flatnonzero(ok & later)
        spans(REMOVE, at, left[at], right[at], at - 1)
        at = np.flatnonzero(after & ~np.append(later[1:], True))
        spans(REMOVE, at, l_next[at], r_next[at], at + 1)
        # What the run's first has too: as much as all neighbours on the way share.
        starts = np.flatnonzero(~ok)
        stops = np.append(starts[1:], n)
        first_of: dict[int, int] = {}
        path: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            edge = s == 0 or e == n
            if e - s < 3 and not edge:
                continue
            f = s + int(np.lexsort((pos[s:e], doc[s:e]))[0])
            r, l = np.full(e - s, least, np.int32), np.full(e - s, w, np.int32)
            r[f + 1 - s :], l[f + 1 - s :] = np.minimum.accumulate(right[f + 1 : e]), np.minimum.accumulate(left[f + 1 : e])
            r[: f - s], l[: f - s] = np.minimum.accumulate(right[s + 1 : f + 1][::-1])[::-1], np.minimum.accumulate(left[s + 1 : f + 1][::-1])[::-1]
            at = s + np.flatnonzero((r + l >= least) & (np.arange(s, e) != f))
            spans(REMOVE, at, l[at - s], r[at - s], np.full(len(at), f))
            if edge:
                first_of[s] = f
                path[s] = (r, l)
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            m = len(cols[0])
            for s in range(0, m, 50_000):
                part = [pa.array(c[s : s + 50_000], t) for c, t in zip(cols, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*part, *(pa.nulls(len(part[0]), t) for t in kinds[6:])], names)
        rows = []
        last = int(starts[-1])
        for place, (s, k, end) in enumerate(((0, 0, ends[0]), (last, n - 1, ends[1]))):
            f, (r, l) = first_of[s], path[s]
            rows.append((EDGE, int(doc[k]), None, None, None, None, end.column(0)[0].as_py(), end.column(1)[0].as_py(), end.column(2)[0].as_py(), int(pos[k]), place, int(doc[f]), int(pos[f]), int(r[k - s]), int(l[k - s]), last == 0, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        del docs, places, rights, lefts, doc, pos, right, left, out, held, both
        tidy()

    return sorted_suffixes.mapInArrow(run, _SCHEMA)


def across(edges: list, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """Spans (kind, doc, start, stop, and where the copy is) found between sorted parts, from the ends of the parts: two rows for each part."""
    edges.sort(key=lambda e: (e["gram"], bytes(e["tail"]), bytes(e["head"]), e["doc"], e["pos"], e["place"]))
    words = lambda b: np.frombuffer(bytes(b), ">u4")[None, :]
    out: list[tuple[int, int, int, int, int, int]] = []
    span = lambda kind, at, l, r, of: (kind, at[0], at[1] - l, at[1] + r, of[0], of[1] - l)
    # Of the runs that go on from part to part: the smallest first so far, and what is shared from it up to here.
    chain: tuple[tuple[int, int], int, int] | None = None
    for k in range(1, len(edges) - 1, 2):  # the last of a part, the first of the next
        before, a, b = edges[k - 1], edges[k], edges[k + 1]
        right = GRAM + int(_common(words(a["tail"]), words(b["tail"]))[0])
        left = int(_common(words(a["head"]), words(b["head"]))[0])
        if a["gram"] != b["gram"] or right + left < least or (a["doc"], a["pos"]) == (b["doc"], b["pos"]):
            chain = None
            continue
        smaller, last = sorted((e["doc"], e["pos"]) for e in (a, b))
        out += [span(REPEAT, e, left, right, e) for e in (smaller, last)]
        out.append(span(REMOVE, last, left, right, smaller))
        own = (a["first_doc"], a["first_pos"])
        if chain and a["whole"] and chain[0] < own:  # through the whole part
            r, l = (min(c, before[path], a[path]) for c, path in zip(chain[1:], ("path_right", "path_left"), strict=True))
            chain = (chain[0], min(r, right), min(l, left))
        else:
            chain = (own, min(a["path_right"], right), min(a["path_left"], left))
        r, l = min(chain[1], b["path_right"]), min(chain[2], b["path_left"])
        smaller, larger = sorted((chain[0], (b["first_doc"], b["first_pos"])))
        if r + l >= least and smaller != larger:
            out.append(span(REMOVE, larger, l, r, smaller))
    return out


def compare_windows(sorted_windows: DataFrame, least: int) -> DataFrame:
    """Spans of the windows (``gram``, ``window``, ``doc``, ``start``) that equal a neighbour, and the ends of each sorted part. A
    window that equals the one before it stands at a smaller document or place, too."""
    names = ["kind", "doc", "start", "copy", "copy_start", "gram", "window", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(k).to_numpy() for k in range(4)]
            if held is None:
                yield edge([x[0] for x in own], 0)
                gram, window, doc, start = own
            else:
                gram, window, doc, start = (np.concatenate(x) for x in zip(held, own, strict=True))
            same = (gram[1:] == gram[:-1]) & (window[1:] == window[:-1])
            same &= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
            for kind, at in ((REPEAT, np.flatnonzero(np.append(same, False) | np.append(False, same))), (REMOVE, np.flatnonzero(same) + 1)):
                if len(at):
                    of = at - 1 if kind == REMOVE else at
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(doc[at]), pa.array(start[at]), pa.array(doc[of]), pa.array(start[of]), *(pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int32()))], names)
            held = [x[-1:] for x in own]
        if held is not None:
            yield edge([x[0] for x in held], 1)

    def edge(row: list, place: int) -> pa.RecordBatch:
        gram, window, doc, start = (int(x) for x in row)
        values = (EDGE, doc, start, doc, start, gram, window, place)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    return sorted_windows.mapInArrow(run, "kind int, doc bigint, start int, copy bigint, copy_start int, gram bigint, window bigint, place int")


def window_spans(windows: DataFrame, least: int) -> DataFrame:
    """(``kind``, ``doc``, ``start``, ``stop``, ``copy``, ``copy_start``) of the windows that stand more than once."""
    order = ["gram", "window", "doc", "start"]
    found = durable(compare_windows(windows.repartitionByRange(*order).sortWithinPartitions(*order), least), "windows")
    edges = sorted(found.where(F.col("kind") == EDGE).drop("kind").collect(), key=lambda e: (e["gram"], e["window"], e["doc"], e["start"], e["place"]))
    more = []
    for a, b in zip(edges[1:-1:2], edges[2::2], strict=True):  # the last of a part, the first of the next
        if (a["gram"], a["window"]) == (b["gram"], b["window"]) and (a["doc"], a["start"]) != (b["doc"], b["start"]):
            one, other = ((x["doc"], x["start"]) for x in (a, b))
            more += [(REPEAT, *one, *one), (REPEAT, *other, *other), (REMOVE, *other, *one)]
    columns = ["kind", "doc", "start", "copy", "copy_start"]
    spans = found.where(F.col("kind") != EDGE).select(*columns)
    if more:
        spans = spans.unionByName(windows.sparkSession.createDataFrame(more, "kind int, doc bigint, start int, copy bigint, copy_start int"))
    return spans.withColumn("stop", F.col("start") + least).select(*SPAN)


#: A span of words of a document (``stop`` excluded), and where its copy begins (for ``REPEAT``: the span itself).
SPAN = ["kind", "doc", "start", "stop", "copy", "copy_start"]


def covers(removed: DataFrame) -> DataFrame:
    """Of each document's spans as few as hold all their words."""
    longest = removed.groupBy("doc", "start").agg(F.max(F.struct("stop", "copy", "copy_start")).alias("e"))
    own = longest.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "e.stop", "e.copy", "e.copy_start"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").flatten()
            start, stop, copy, copy_start = (spans.field(k).to_numpy() for k in range(4))
            ends = b.column("spans").offsets.to_numpy() - b.column("spans").offsets[0].as_py()
            out = []
            for k, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                have = -1  # words up to here are held, or in no span
                while k < e:
                    have, best = max(have, start[k]), k
                    while k < e and start[k] <= have:  # the one that goes furthest of those that begin there
                        best = k if stop[k] > stop[best] else best
                        k += 1
                    if stop[best] > have:
                        out.append(best)
                        have = stop[best]
            at = np.array(out, np.int64)
            doc = np.repeat(b.column("doc").to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), REMOVE, np.int32)), *(pa.array(x[at]) for x in (doc, start, stop, copy, copy_start))], SPAN)

    return own.mapInArrow(run, "kind int, doc bigint, start int, stop int, copy bigint, copy_start int")


def confirmed(removed: DataFrame, source: DataFrame) -> DataFrame:
    """The spans whose words are those of their copies, byte by byte (by a 128-bit digest)."""
    size = F.col("stop") - F.col("start")
    both = removed.select("doc", "start", "stop").unionByName(removed.select(F.col("copy").alias("doc"), F.col("copy_start").alias("start"), (F.col("copy_start") + size).alias("stop")))
    # As many as a document has spans, however many documents have copies of them.
    asked = both.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column("text"))
            starts, ends, row = word_spans(data, off)
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            at = b.column("at").flatten()
            start, stop = (at.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column("at").offsets.to_numpy()))
            raw = data.tobytes()
            first, last = starts[np.minimum(begin[of] + start, len(starts) - 1)], ends[np.minimum(begin[of] + stop, begin[of + 1]) - 1]
            out = [hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b.column("doc").to_numpy()[of]), at.field(0), at.field(1), pa.array(out, pa.binary())], ["doc", "start", "stop", "digest"])

    asked = durable(asked, "asked")
    told = durable(asked_of(source, asked).mapInArrow(run, "doc bigint, start int, stop int, digest binary"), "digests")
    release(asked)
    of_copy = told.select(F.col("doc").alias("copy"), F.col("start").alias("copy_start"), F.col("stop").alias("copy_stop"), F.col("digest").alias("copy_digest"))
    own = removed.join(told, ["doc", "start", "stop"]).withColumn("copy_stop", F.col("copy_start") + size)
    return own.join(of_copy, ["copy", "copy_start", "copy_stop"]).where("digest = copy_digest").select(*SPAN)


def repeated_spans(source: DataFrame, least: int) -> DataFrame:
    """Spans of words of (``doc``, ``text``) that repeat (``REPEAT``), as a document's suffixes gave them: overlapping, and several for a
    passage; and spans that can go (``REMOVE``), confirmed on the words."""
    spark = source.sparkSession
    keys = durable(suffix_keys(source, least), "suffixes")
    # Summed per task before the shuffle: a frequent passage's suffix is one row for each.
    often = keys.groupBy("gram").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("pos").alias("p0"), F.max("pos").alias("p1")).where("d0 < d1 or p0 < p1").select("gram")
    often = durable(often, "often")  # read again, so that the join below may split a frequent suffix's rows
    places = durable(keys.join(often, "gram", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("gram", "pos")).alias("at")), "places")
    release(keys, often)
    order = ["gram", "tail", "head", "doc", "pos"]
    suffixes = contexts(asked_of(source, places), least)
    array = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = durable(compare(array, least), "matches")
    release(places)
    edges = [r.asDict() for r in found.where(F.col("kind") == EDGE).collect()]  # two rows for each part
    spans = found.where(F.col("kind").isin(REPEAT, REMOVE)).select(*SPAN)
    spans = spans.unionByName(window_spans(found.where(F.col("kind") == WINDOW).select("gram", "window", "doc", "start"), least))
    more = across(edges, least)
    if more:
        spans = spans.unionByName(spark.createDataFrame(more, "kind int, doc bigint, start int, stop int, copy bigint, copy_start int"))
    removed = durable(covers(spans.where(F.col("kind") == REMOVE)), "removed")
    return spans.where(F.col("kind") == REPEAT).unionByName(confirmed(removed, source))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of each document and kind, joined where they meet: ``doc``, ``kind``, ``start``, ``stop``."""
    own = spans.groupBy("doc", "kind", "start").agg(F.max("stop").alias("stop"))
    w = W.partitionBy("doc", "kind").orderBy("start")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = own.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    part = new.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy("doc", "kind", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def passages_of(source: DataFrame, least: int) -> DataFrame:
    """(``doc``, ``n_repeated``, ``n_removed``, ``repeats``, ``removed``) of the documents that have repeated passages."""
    spans = merged(repeated_spans(source, least)).select("doc", F.struct("start", "stop").alias("span"), "kind")
    own = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("span"))))
    words = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("span.stop") - F.col("span.start"))), F.lit(0)).cast("bigint")
    return spans.groupBy("doc").agg(words(REPEAT).alias("n_repeated"), words(REMOVE).alias("n_removed"), own(REPEAT).alias("repeats"), own(REMOVE).alias("removed"))


def repeated_passages(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that have passages of ``least`` words or more which repeat, in another document or their own.

    Returns a row for each such document: ``key``, ``n_repeated`` and ``n_removed`` long (words), ``repeats`` and ``removed``
    (arrays of structs ``start``, ``stop``: the words that repeat, and those of them that also stand at a smaller document
    or place). Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte; white space does not matter. Null and empty texts,
    and texts under ``least`` words, have none. Keys may be of any type that has an order. Rows that repeat a key and its text
    are one document; rows that repeat a key with another text are documents of their own, with rows of their own. Rows
    without a key are left out. An empty table gives no rows.
    """
    source, names = identified(docs, text, key)
    out = passages_of(source, least)
    if names is not None:
        out = out.join(names.select("doc", "key"), "doc").drop("doc").withColumnRenamed("key", "doc")
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_repeated", "n_removed", "repeats", "removed")


def drop_repeats(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """The documents without the passages that also stand at a smaller document or place. A removed word goes with the
    white space before it; what is left is unchanged, to the byte. Documents keep their row, if with an empty text;
    ``length``, if there is such a column, is the new number of characters. Rows without a key, and null texts, stay. Rows
    that repeat a key are cut by the places that their own texts gave. Columns may have any names."""
    columns = list(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    text, key = f"c{columns.index(text)}", f"c{columns.index(key)}"
    source, names = identified(plain, text, key)
    cut = passages_of(source, least).where("n_removed > 0").select("doc", F.col("removed").alias("cut"))
    fields = list(plain.columns)
    if names is not None:  # by key and text
        cut = cut.join(names, "doc").select(F.struct("key", "same").alias("doc"), "cut")
        plain = plain.withColumn("own", F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("same"))))
        key = "own"
    cut = durable(cut, "cut")
    # Documents that stay as they are need not be moved.
    touched = few(cut.select(F.col("doc").alias(key)))
    same = plain.join(touched, key, "left_anti")
    changed = plain.join(touched, key, "left_semi").join(cut, F.col(key) == F.col("doc"))
    at = fields.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            out = []
            for k in range(b.num_rows):
                data, off = text_bytes(b.column(text).slice(k, 1))
                starts, ends, _ = word_spans(data, off)
                keep = np.ones(len(data), bool)
                for span in b.column("cut")[k].as_py():
                    s, e = max(0, span["start"]), min(span["stop"], len(ends))
                    if s < e:
                        keep[int(ends[s - 1]) if s else 0 : int(ends[e - 1])] = False
                left = data[keep]
                if len(left) and SPACE[left[0]] and not keep[0]:
                    left = left[int(np.argmax(~SPACE[left])) if (~SPACE[left]).any() else len(left) :]
                out.append(left.tobytes().decode())
            values = [b.column(c) for c in fields]
            values[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(values, fields)

    new = changed.select(*fields, "cut").mapInArrow(run, plain.select(*fields).schema)
    if length and length in columns:
        where = f"c{columns.index(length)}"
        new = new.withColumn(where, F.length(text).cast(plain.schema[where].dataType))
    return same.select(*fields).unionByName(new).toDF(*columns)
