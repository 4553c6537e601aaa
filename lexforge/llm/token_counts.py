"""Token counts by a finite-state tokenizer.

A byte-pair vocabulary is compiled into a deterministic transducer. It reads the symbols of a word; a state stands for
all that the future of an encoding depends on (the last token at each place that a longer token could still reach back
to, and the token counts there), and a transition is annotated with the number of tokens it adds to the count, which
is negative where a symbol joins earlier tokens into one. States and transitions are made when first met, and kept
in a table of bounded size.

A text's words (as the library normalises and splits it) are one run of symbols, in which a symbol that ends a word leads back
to the first state. The run is cut into chunks of so many symbols, wherever that falls, also inside words. A chunk's map
takes the state that arrives at it to the state that leaves it and the tokens counted on the way. It is made, for each
chunk alone, for the state that is live there: the first, or inside a word the one that the symbols before lead to from an
earlier place. Maps compose associatively, in pairs and then pairs of pairs; a state that no map was made for is run
through the chunk when it arrives. What a whole word does to the first state is kept in a table of bounded size, as the part of a map that most text
needs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .sentencepiece_codec import _Table

KEPT_STATES, KEPT_WORDS, KEPT_PAIRS = 150_000, 400_000, 400_000
#: Symbols of a chunk, and of the stretch before it that tells a state which may arrive; words of fewer characters than ``LONG``
#: are kept in a table.
CHUNK, WARM, LONG = 1 << 16, 64, 64


def byte_symbols() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest
    for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class CountTransducer:
    """Counts a word's tokens: merges by rank, the last symbol of a word marked by a suffix.

    A symbol is one character: a byte's code point, or 256 more for a byte that ends a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        plain = {c: chr(b) for b, c in enumerate(byte_symbols())}

        def symbols(token: str) -> str | None:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            out = [plain.get(c) for c in (token[: -len(suffix)] if ends else token)]
            if None in out:
                return None
            if ends:
                out[-1] = chr(ord(out[-1]) + 256)
            return "".join(out)

        self.ranks: dict[tuple[str, str], int] = {}
        self.tokens: set[str] = set()
        for r, (a, b) in enumerate(merges):
            pair = symbols(a), symbols(b)
            if None not in pair and a + b in vocab:
                self.ranks.setdefault(pair, r)
                self.tokens.add(pair[0] + pair[1])
        self.tokens |= {s for t in vocab if (s := symbols(t)) and len(s) == 1}
        self.prefixes = {s[:k] for s in self.tokens for k in range(1, len(s) + 1)}
        self.stories = _Table(self._story, len(self.tokens) + 1)
        self.fits = _Table(self._fits, KEPT_PAIRS)
        self.reset()

    def reset(self) -> None:
        #: A state: symbols that a token may still start with, then (last token, tokens) at each place among them.
        self.keys: list[tuple] = [FIRST]
        self.numbers = {FIRST: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _story(self, token: str) -> tuple[list[int], list[str], list[str]] | None:
        """How merging builds a token: the merges' ranks in their order, and the first and the last symbol before each
        and at the end. None if merging its symbols gives something else."""
        symbols, ranks = list(token), self.ranks
        order, first, last = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = None, -1
            for k, pair in enumerate(zip(symbols, symbols[1:])):  # noqa: B905
                r = ranks.get(pair)
                if r is not None and (at < 0 or r < best):
                    best, at = r, k
            if at < 0:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            order.append(best), first.append(symbols[0]), last.append(symbols[-1])
        return order, first, last

    def _fits(self, pair: tuple[str, str]) -> bool:
        """May the second token follow the first (or, if that is empty, begin a word)? Both are merged anew, side by
        side; they fit unless a merge across their border comes first."""
        a, b = pair
        right = self.stories[b]
        if not a or right is None:
            return right is not None
        left = self.stories[a]
        if left is None:
            return False
        (own, _, ends), (others, begins, _) = left, right
        x, y, n, m, ranks = 0, 0, len(own), len(others), self.ranks
        while True:
            cross = ranks.get((ends[x], begins[y]))
            if cross is not None and (x == n or cross < own[x]) and (y == m or cross <= others[y]):
                return False
            if x < n and (y == m or own[x] <= others[y]):
                x += 1
            elif y < m:
                y += 1
            else:
                return True

    def _compile(self, key: tuple, symbol: str) -> tuple[int, int]:
        """The transition of a state by a symbol: next state, tokens added."""
        recent, places = key
        run, now, n = recent + symbol, places[-1][1], len(recent) + 1
        tokens, fits, prefixes = self.tokens, self.fits, self.prefixes
        token, keep, kept = None, n, []
        for k in range(n):  # the longest token first
            rest = run[k:]
            if rest not in prefixes:
                if k >= keep:
                    kept.append(None)  # no longer token begins here
                continue
            keep = min(k, keep)
            kept.append(places[k])
            if token is None and rest in tokens and fits[places[k][0], rest]:
                token, count = rest, places[k][1] + 1
        if token is None:
            raise ValueError(f"no token ends with {symbol!r}")
        new = (run[keep:], (*(p and (p[0], p[1] - count) for p in kept), (token, 0)))
        return self.number_of(new), count - now

    def number_of(self, key: tuple) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return number

    def go(self, key: tuple, symbols: str) -> tuple[tuple, int]:
        """(state, tokens) after symbols of one word, from a state given by its key."""
        state, total = self.number_of(key), 0
        moves = self.moves
        for s in symbols:
            got = moves[state].get(s)
            if got is None:
                key = self.keys[state]
                if len(self.keys) >= KEPT_STATES:  # the table starts anew, with this state
                    self.reset()
                    moves, state = self.moves, self.number_of(key)
                got = moves[state][s] = self._compile(key, s)
            state, add = got
            total += add
        return self.keys[state], total

    def run(self, symbols: str) -> int:
        """Tokens of a word."""
        return self.go(FIRST, symbols)[1]


#: The state before a word: nothing read, no token.
FIRST: tuple = ("", (("", 0),))


class ChunkMap:
    """What a stretch of symbols does: the state that arrives at it to (the state that leaves it, tokens).

    A chunk goes on with a word (``head``, to its end if ``ends``), has whole words (``tokens`` of them), and begins one (``tail``)."""

    def __init__(self, transducer: CountTransducer, head: str, ends: bool, tokens: int, tail: str):
        self.transducer, self.head, self.ends, self.tokens, self.tail = transducer, head, ends, tokens, tail
        self.table: dict[tuple, tuple[tuple, int]] = {}

    def of(self, state: tuple) -> tuple[tuple, int]:
        got = self.table.get(state)
        if got is None:
            left, total = self.transducer.go(state, self.head)
            if self.ends:
                left = FIRST
            if not self.head or self.ends:
                left, more = self.transducer.go(left, self.tail)
                total += self.tokens + more
            got = self.table[state] = left, total
        return got


class Composed(ChunkMap):
    """One map after another."""

    def __init__(self, first: ChunkMap, second: ChunkMap):
        self.first, self.second = first, second
        self.table = {s: self._through(s) for s in first.table}

    def _through(self, state: tuple) -> tuple[tuple, int]:
        middle, n = self.first.of(state)
        left, m = self.second.of(middle)
        return left, n + m

    def of(self, state: tuple) -> tuple[tuple, int]:
        if state not in self.table:
            self.table[state] = self._through(state)
        return self.table[state]


class Counter:
    """Counts the tokens of texts with one vocabulary file (lower-cased words with byte symbols and word ends)."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a byte-pair vocabulary with word ends is needed")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
            raise ValueError("another normalisation or model than the one that is compiled here")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"]
        self.transducer = CountTransducer(model["vocab"], merges, self.suffix)
        #: Its tables of cases and classes serve where they might differ from Python's.
        self.library = Tokenizer.from_str(raw.decode())
        self.bytes = {c: chr(b) for b, c in enumerate(byte_symbols())}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(split)
        ascii_split = split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.ascii_words_of = re.compile(ascii_split, re.ASCII)
        special = [a["content"] for a in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = _Table(self._word, KEPT_WORDS)

    @staticmethod
    def symbols(word: str) -> str:
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        return raw[:-1] + chr(ord(raw[-1]) + 256)

    def _word(self, word: str) -> int:
        return self.transducer.run(self.symbols(word))

    def normal(self, text: str) -> str:
        """Composed, lower-cased; white space stays as it is, as it only separates."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if self.rare.search(text):
            return self.library.normalizer.normalize_str(text)
        return text.replace("İ", "i̇").lower()

    rare = re.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u205e]")

    def words_in(self, text: str) -> list[str]:
        """The words of a normalised text."""
        if text.isascii():
            return self.ascii_words_of.findall(text)
        if self.rare.search(text):
            return ["".join(map(self.bytes.__getitem__, w)).encode("latin-1").decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words_of.findall(text)

    def chunks(self, words: list[str]) -> Iterator[ChunkMap]:
        """The maps of chunks of ``CHUNK`` symbols, each made for the state that may be live at its beginning."""
        head, ends, tokens, size = "", False, 0, 0
        live = FIRST  # what may arrive at the chunk that is being made

        def made(tail: str) -> ChunkMap:
            out = ChunkMap(self.transducer, head, ends, tokens, tail)
            out.of(live)
            return out

        for word in words:
            if size + len(word) < CHUNK and len(word) < LONG:
                tokens += self.words[word]
                size += len(word)
                continue
            symbols, at = self.symbols(word), 0
            while len(symbols) - at > (room := max(1, CHUNK - size)):
                if at:
                    head = symbols[at : at + room]
                    yield made("")
                else:
                    yield made(symbols[:room])
                at += room
                # From an earlier place, the symbols before a chunk mostly lead to the state that does arrive.
                live = self.transducer.go(FIRST, symbols[max(0, at - WARM) : at])[0]
                head, ends, tokens, size = "", False, 0, 0
            if at:
                head, ends = symbols[at:], True
            else:
                tokens += self.words[word] if len(word) < LONG else self.transducer.run(symbols)
            size += len(symbols) - at
            if size >= CHUNK:
                yield made("")
                live, head, ends, tokens, size = FIRST, "", False, 0, 0
        yield made("")

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps in one, composed in pairs, then pairs of pairs."""
        while len(maps) > 1:
            maps = [Composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.special and "<" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if part:
                words = self.words_in(self.normal(part))
                if len(part) < CHUNK and (not words or max(map(len, words)) < LONG):  # one chunk of short words
                    total += sum(map(self.words.__getitem__, words))
                else:
                    total += self.scan(list(self.chunks(words))).of(FIRST)[1]
        return total


_counters: dict[int, Counter] = {}


def counter(raw: bytes) -> Counter:
    key = hash(raw)
    if key not in _counters:
        _counters[key] = Counter(raw)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens of each whole text, without any that frame it; special strings inside count as the one token they are.

    Returns ``keys``, ``n_bytes`` long (UTF-8), ``n_tokens`` long and ``over_limit`` (more tokens than ``limit``).
    A null text counts as empty and has no tokens. Every row is kept as it is, null keys and repeated rows too; other
    columns are left out. One pass without a shuffle; tables of words, states and pairs are bounded.
    """
    with open(vocabulary_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(*keys, docs[text].alias("__text"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(raw.value)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py() or ""
                sizes.append(len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")))
                counts.append(c.count(t))
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keys, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
