"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly as the library does.

Encoding works by backtracking. An Aho-Corasick automaton of all pieces gives the pieces that start at a position,
longest first. A piece may follow another if merging the characters of both anew, by score and from the left, leads
back to just these two; as merges across the ends of other pieces cannot come first otherwise, a sequence whose
neighbours all pass is the one that merging the whole text gives. Where no piece fits, the position's bit is cleared
and the search steps back; a cleared position is never entered again, so the search is linear in practice.

No piece has the space mark after another character, so words are independent, and their encodings are kept in a
bounded table. Characters without a piece become byte pieces, and nothing merges across them.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encodings of words, and verdicts on pairs of pieces, that a Python worker keeps before it starts anew.
KEPT_WORDS, KEPT_PAIRS = 400_000, 400_000
#: Characters of a text that are encoded together.
STRETCH = 1 << 18


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            c = buf[i]
            value, shift, i = value | (c & 127) << shift, shift + 7, i + 1
            if c < 128:
                return value, i

    while i < n:
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 8 if wire == 1 else 4
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file. Only what the exact method covers is accepted: merge type, no normalisation."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, rules, dummy, extra, escape, fallback = 1, b"", 1, 1, 1, 0
        for field, value in _fields(raw):
            if field == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        type_ = v
                self.pieces.append(piece), self.scores.append(score), self.types.append(type_)
            elif field == 2:
                own = dict(_fields(value))
                kind, fallback = own.get(3, 1), own.get(35, 0)
            elif field == 3:
                own = dict(_fields(value))
                rules, dummy, extra, escape = own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)
        if any("\n" in p for p in self.pieces):
            raise ValueError("a piece has a line end, so lines are not independent")
        if kind != 2 or rules or extra or not escape or USER in self.types:
            raise ValueError("only merge-type models without normalisation and user-defined pieces are covered")
        self.dummy_prefix, self.byte_fallback = bool(dummy), bool(fallback)
        self.unk = self.types.index(UNKNOWN)
        control = {self.pieces[i]: i for i, t in enumerate(self.types) if t == CONTROL}
        self.bos, self.eos = control.get("<s>", -1), control.get("</s>", -1)
        if any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL):
            raise ValueError("a piece has the space mark after another character, so words are not independent")


class _Table(dict):
    """Computes what is missing. Of bounded size: when it is full, only what is asked for again stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes and decodes with one model; kept by each Python worker."""

    def __init__(self, raw: bytes):
        m = self.model = PieceModel(raw)
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == NORMAL}
        self.rank = {p: m.scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        self.chars = {p for p in self.ids if len(p) == 1}
        self.stories = _Table(self._story, len(m.pieces) + 1)
        self.fits = _Table(self._fits, KEPT_PAIRS)
        self.words = _Table(self._word, KEPT_WORDS // 8)
        self.marked = _Table(lambda w: self._word(MARK + w), KEPT_WORDS)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.line = self._word("\n")
        self.surface = [self._surface(i) for i in range(len(m.pieces))]
        self.is_byte = np.array([t == BYTE for t in m.types])

    # --- encoding

    def _story(self, i: int) -> tuple[list[float], list[str], list[str]] | None:
        """How merging builds a piece from its characters: the scores of the merges in their order, and the first and
        the last symbol before each and at the end. None if merging those characters gives something else."""
        symbols, rank = list(self.model.pieces[i]), self.rank
        scores, first, last = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = None, -1
            for k, pair in enumerate(map(str.__add__, symbols, symbols[1:])):
                r = rank.get(pair)
                if r is not None and (at < 0 or r > best):
                    best, at = r, k
            if at < 0:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(best), first.append(symbols[0]), last.append(symbols[-1])
        return scores, first, last

    def _fits(self, pair: tuple[int, int]) -> bool:
        """May the second piece follow the first (or, if that is -1, stand at the start)?

        Both are merged anew, side by side: the better of their next merges comes first, the left one of equals; they
        fit unless a merge across their border comes before.
        """
        a, b = pair
        right = self.stories[b]
        if a < 0 or right is None:
            return right is not None
        left = self.stories[a]
        if left is None:
            return False
        (scores, _, ends), (others, begins, _) = left, right
        x, y, n, m, rank = 0, 0, len(scores), len(others), self.rank
        while True:
            cross = rank.get(ends[x] + begins[y])
            if cross is not None and (x == n or cross > scores[x]) and (y == m or cross >= others[y]):
                return False
            if x < n and (y == m or scores[x] >= others[y]):
                x += 1
            elif y < m:
                y += 1
            else:
                return True

    def _starts(self, text: str, block: int, size: int = 4096) -> dict[int, list[tuple[int, int]]]:
        """For each position of a block: the pieces that start there, shortest first."""
        low, high = block * size, min(len(text), (block + 1) * size + self.longest)
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (i, n) in self.automaton.iter(text, low, high):
            found.setdefault(end - n + 1, []).append((n, i))
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n, pos, out, blocks, failed = len(text), 0, [], {}, bytearray(len(text) // 8 + 1)
        fits, size = self.fits, 4096

        def pieces(at: int) -> list[tuple[int, int]]:
            block = at // size
            if block not in blocks:
                while len(blocks) > 3:
                    del blocks[next(iter(blocks))]
                blocks[block] = self._starts(text, block, size)
            return blocks[block][at]

        trail: list[list[tuple[int, int]]] = []  # for each piece taken, the shorter ones not yet tried
        options = list(pieces(0)) if n else []
        while pos < n:
            last = out[-1] if out else -1
            while options:
                length, i = options.pop()
                end = pos + length
                if not failed[end >> 3] >> (end & 7) & 1 and fits[last, i]:
                    out.append(i)
                    trail.append(options)
                    pos = end
                    options = list(pieces(pos)) if pos < n else []
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError("no encoding")  # cannot be: merging always ends
                pos -= len(self.model.pieces[out.pop()])
                options = trail.pop()
        return out

    def _short(self, text: str) -> list[int]:
        """As ``_backtrack``, for a word: all matches are listed at once."""
        n, pos, last, out, failed, fits = len(text), 0, -1, [], 0, self.fits
        for _, (i, _) in self.automaton.iter_long(text):  # the longest pieces one after the other
            if not fits[last, i]:
                break
            out.append(i)
            last = i
        else:
            return out
        last, out = -1, []
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, size) in self.automaton.iter(text):
            starts[end + 1 - size].append((end + 1, i))
        trail, options = [], starts[0].copy()
        while True:
            while options:
                end, i = options.pop()
                if not failed >> end & 1 and fits[last, i]:
                    out.append(i)
                    if end == n:
                        return out
                    trail.append((pos, options))
                    pos, last, options = end, i, starts[end].copy()
                    break
            else:
                failed |= 1 << pos
                out.pop()
                pos, options = trail.pop()
                last = out[-1] if out else -1

    def _word(self, word: str) -> bytes:
        """Packed ids of a word; what has no piece becomes bytes."""
        if self.chars.issuperset(word):
            ids = self._short(word) if len(word) < 256 else self._backtrack(word)
            return struct.pack(f"<{len(ids)}I", *ids)
        out: list[int] = []
        known = ""
        for c in [*word, None]:
            if c in self.chars:
                known += c
                continue
            if known:
                out += self._backtrack(known)
                known = ""
            if c is not None:
                if self.model.byte_fallback:
                    out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                elif not out or out[-1] != self.model.unk:
                    out.append(self.model.unk)
        return struct.pack(f"<{len(out)}I", *out)

    def _stretches(self, text: str) -> Iterator[str]:
        """The text with space marks, cut where a word begins, or where it must be at no such place."""
        text = ((" " if self.model.dummy_prefix else "") + text).replace(" ", MARK) if text else ""
        start = 0
        while len(text) - start > STRETCH:
            cut = text.find(MARK, start + STRETCH)
            while cut > 0 and text[cut - 1] == MARK:
                cut = text.find(MARK, cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        if start < len(text):
            yield text[start:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian ids, a stretch of the text at a time, without begin and end."""
        get, marked = self.words.__getitem__, self.marked.__getitem__
        for stretch in self._stretches(text):
            out = []
            for line in stretch.split("\n"):
                words = line.split(MARK)
                if "" in words[1:] or max(map(len, words)) >= 256:
                    # Several spaces go together; a long run without any is no word to keep.
                    out += [get(s) if len(s) < 256 else self._word(s) for s in self.segments.findall(line)]
                else:
                    if words[0]:
                        out.append(get(words[0]))
                    out += map(marked, words[1:])
                out.append(self.line)
            out.pop()
            yield b"".join(out)

    # --- decoding

    def _surface(self, i: int) -> bytes:
        m = self.model
        if m.types[i] == CONTROL:
            return b""
        if m.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        if m.types[i] == BYTE:
            return bytes([int(m.pieces[i][3:5], 16)])
        return m.pieces[i].replace(MARK, " ").encode()

    def decode(self, parts: Iterator[np.ndarray]) -> Iterator[str]:
        """Text of ids, given and returned a part at a time. A space that the dummy prefix put first is dropped;
        bytes that are no UTF-8 become U+FFFD, one for each."""
        surface, kept, first = self.surface.__getitem__, np.zeros(0, np.int64), self.model.dummy_prefix

        def text(ids: np.ndarray) -> str:
            raw = b"".join(map(surface, ids.tolist()))
            try:
                return raw.decode()
            except UnicodeDecodeError:
                out, run = [], b""
                for i in [*ids.tolist(), -1]:
                    if i >= 0 and self.is_byte[i]:
                        run += surface(i)
                        continue
                    while run:
                        for size in (1, 2, 3, 4):
                            try:
                                out.append(run[:size].decode())
                                break
                            except UnicodeDecodeError:
                                size = 0
                        else:
                            out.append("�")
                        run = run[size or 1 :]
                    if i >= 0:
                        out.append(surface(i).decode())
                return "".join(out)

        for part in parts:
            ids = np.concatenate([kept, part]) if len(kept) else part
            end = len(ids)
            while end and self.is_byte[ids[end - 1]]:
                end -= 1  # bytes at the end may belong to a character that goes on
            kept, ids = ids[end:], ids[:end]
            got = text(ids)
            if first and got:
                first, got = False, got.removeprefix(" ") if not self._byte_first(ids) else got
            yield got
        got = text(kept)
        yield got.removeprefix(" ") if first and got and not self._byte_first(kept) else got

    def _byte_first(self, ids: np.ndarray) -> bool:
        shown = [i for i in ids[:4].tolist() if self.model.types[i] != CONTROL]
        return bool(shown) and bool(self.is_byte[shown[0]])


_codecs: dict[int, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The worker's codec of a model; models are told apart by content."""
    key = hash(raw)
    if key not in _codecs:
        _codecs[key] = Codec(raw)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode each whole text with begin and end ids, and decode the ids again.

    Returns ``keys``, ``n_tokens`` long (all ids), ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (of the decoded text in UTF-8) and, if asked for, ``token_ids`` binary (those
    integers themselves). A null text counts as empty, and an empty one has the begin and end ids alone. Rows stay as
    they are: repeated rows and null keys are kept, other columns are left out. One pass, no shuffle; a text is held
    once, its words' encodings in a table of bounded size.
    """
    with open(model_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(*keys, docs[text].alias("__text"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value)
        begin, end = (struct.pack("<I", i) for i in (c.model.bos, c.model.eos))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, ids_of, texts_of, packed = [], [], [], []
                for value in part.column(part.num_columns - 1):
                    ids, back, n, held = hashlib.sha256(begin), hashlib.sha256(), 2, [begin]

                    def numbers(t: str) -> Iterator[np.ndarray]:
                        nonlocal n
                        for b in c.encode(t):
                            ids.update(b)
                            n += len(b) // 4
                            if with_ids:
                                held.append(b)
                            yield np.frombuffer(b, "<u4")

                    for t in c.decode(numbers(value.as_py() or "")):
                        back.update(t.encode("utf-8", "surrogatepass"))
                    ids.update(end)
                    counts.append(n), ids_of.append(ids.hexdigest()), texts_of.append(back.hexdigest())
                    if with_ids:
                        packed.append(b"".join([*held, end]))
                columns = [pa.array(counts, pa.int64()), pa.array(ids_of), pa.array(texts_of)] + [pa.array(packed, pa.binary())] * with_ids
                names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names)

    return source.mapInArrow(run, schema)
