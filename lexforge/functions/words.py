"""The folded tokens of texts in Python, for the passes that look at every word: as ``text.tokens`` gives them, many times faster."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .porter import stem
from .text import plain_letters

#: Words with letters beyond ASCII, or stems, whose result is kept; bytes of text that are looked at together.
KEPT, BYTES = 200_000, 4 << 20
_RUN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_ASCII = re.compile("[0-9a-z]+")
_FOLDED = regex.compile(r"[\p{L}\p{N}\p{Co}]+")
_MARK = regex.compile(r"\p{M}+")
_known: dict[str, list[str]] = {}
_stems: dict[str, str] = {}


def _fold(text: str) -> str:
    """As ``text.fold``."""
    return _MARK.sub("", text.translate(_plain())).lower()


@functools.cache
def _plain() -> dict[int, str]:
    return dict(zip(map(ord, plain_letters()[0]), plain_letters()[1], strict=True))


def words(text: str | None) -> list[str]:
    """The folded tokens of a text, in order."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    if "Σ" in text:  # the one letter whose lower case depends on what is around it
        return _FOLDED.findall(_fold(text))
    out: list[str] = []
    for run in _RUN.findall(text):
        if run.isascii():
            out.append(run.lower())
            continue
        own = _known.get(run)
        if own is None:
            own = _FOLDED.findall(_fold(run))
            if len(run) <= 64:
                if len(_known) >= KEPT:
                    _known.clear()
                _known[run] = own
        out += own
    return out


def stem_of(term: str) -> str:
    """The stem of a term; made once while it is kept."""
    out = _stems.get(term)
    if out is None:
        if len(_stems) >= KEPT:
            _stems.clear()
        out = _stems[term] = stem(term)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that no slice of several rows holds more than ``limit`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(offsets(batch.column(batch.schema.get_field_index(column)))[1])
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN = np.zeros(256, bool)
_IN[48:58] = _IN[97:123] = _IN[128:] = True


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes of each, all bytes) of an array of strings or bytes."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return at, np.diff(at), data


def encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, number of each token in order, tokens of each row) of an array of texts. Runs of letters and digits, and of
    anything beyond ASCII, are found in the bytes and told apart; only distinct runs with more than ASCII are folded one by one."""
    at, sizes, data = offsets(texts)
    if texts.null_count:  # bytes behind a null are nobody's
        texts = texts.fill_null("")
        at, sizes, data = offsets(texts)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    if ((data[:-1] == 0xCE) & (data[1:] == 0xA3)).any():  # a capital sigma: see ``words``
        rows = [words(x) for x in texts.to_pylist()]
        flat = pa.array(list(chain.from_iterable(rows)), pa.string()).dictionary_encode()
        return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), np.array([len(r) for r in rows], np.int64)
    data = _LOWER[data]
    inside = _IN[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][sizes > 0]
    begins[first] = inside[first]  # a run does not go on in the next text
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int64)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    runs = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
    number = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.searchsorted(starts, at)
    lens = np.diff(of)
    names = runs.dictionary
    ends_, _, own = offsets(names)
    high = np.append(0, np.cumsum(own >= 128))
    beyond = np.flatnonzero(high[ends_[1:]] > high[ends_[:-1]]) if len(names) else np.zeros(0, np.int64)
    if not len(beyond):
        return names, number, lens
    # Runs beyond ASCII are folded together: each is some tokens, mostly one.
    lines = _fold("\n".join(names.take(pa.array(beyond)).to_pylist())).split("\n")
    parts = [[x] if x.isalpha() and x.isascii() else _FOLDED.findall(x) for x in lines]
    plain = np.ones(len(names), bool)
    plain[beyond] = False
    every = pa.concat_arrays([names.filter(pa.array(plain)), pa.array(list(chain.from_iterable(parts)), pa.string())]).dictionary_encode()
    code = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.ones(len(names), np.int64)
    count[beyond] = [len(x) for x in parts]
    # Where each run's tokens are in ``code``: plain runs come first, then the others' tokens.
    where = np.zeros(len(names), np.int64)
    where[plain] = np.arange(plain.sum())
    where[beyond] = plain.sum() + np.cumsum(count[beyond]) - count[beyond]
    times = count[number]
    out = np.repeat(where[number] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    sums = np.append(0, np.cumsum(times))
    return every.dictionary, code[out], sums[of[1:]] - sums[of[:-1]]


class Phrases:
    """The places of phrases in encoded texts. ``families``: the terms that each word of each phrase stands for (None: itself); ``stemmed``:
    words are stems, and so are tokens."""

    def __init__(self, phrases: list[tuple[list[str], bool]], families: list[list[list[str]]] | None = None, stemmed: bool = False):
        self.phrases, self.families, self.stemmed = phrases, families, stemmed

    def hits(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(for each phrase the tokens where it begins, row of each token, tokens of each row)."""
        names, number, lens = encoded(texts)
        row = np.repeat(np.arange(len(lens)), lens)
        if self.stemmed:
            names = pa.array([stem_of(x) for x in names.to_pylist()], pa.string())
        out = []
        for i, (terms, prefix) in enumerate(self.phrases):
            found = None
            for k, t in enumerate(terms):
                if self.families is not None:
                    own = pc.is_in(names, value_set=pa.array(self.families[i][k], pa.string()))
                elif prefix and k == len(terms) - 1:
                    own = pc.starts_with(names, t)
                else:
                    own = pc.equal(names, t)
                is_word = own.to_numpy(zero_copy_only=False).astype(bool)
                if found is None:
                    found = np.flatnonzero(is_word[number])
                else:
                    found = found[found + k < len(number)]
                    found = found[is_word[number[found + k]] & (row[found + k] == row[found])]
            out.append(found)
        return out, row, lens

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how often each phrase is in each row, tokens of each row)."""
        hits, row, lens = self.hits(texts)
        return np.array([np.bincount(row[h], minlength=len(lens)) for h in hits], np.int32).reshape(len(hits), len(lens)), lens

    def places(self, texts: pa.Array) -> list[list[list[int]]]:
        """For each row and phrase, the places in the row (from 0) where it begins."""
        hits, row, lens = self.hits(texts)
        start = np.cumsum(lens) - lens
        out: list[list[list[int]]] = [[[] for _ in hits] for _ in lens]
        for i, h in enumerate(hits):
            for r, at in zip(row[h].tolist(), (h - start[row[h]]).tolist(), strict=True):
                out[r][i].append(at)
        return out
