"""Excerpts of the few rows that are shown: snippets around hits, and previews of chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from .text import TOKEN, fold_py

#: Tokens of a snippet.
WINDOW = 12
#: Code points of a preview.
PREVIEW = 200


@dataclass(frozen=True)
class Span:
    term: str
    start: int
    end: int


_TOKEN = regex.compile(TOKEN)


def token_spans(text: str) -> list[Span]:
    """The folded tokens of a text and where they stand in it."""
    return [Span(fold_py(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def snippet(text: str, hits: list[tuple[int, int, int]], spans: list[Span] | None = None, width: int = WINDOW) -> str:
    """The best window of ``width`` tokens, with hits in brackets. ``hits``: (first token, phrase number, tokens).

    A window scores 1000 for each phrase that it shows and 1 for each further hit; one that begins a sentence scores
    100 more, and 120 at the start of the text. Of equals the first stays.
    """
    spans = token_spans(text) if spans is None else spans
    hits, n = sorted(hits), len(spans)
    starts = [k for k in range(n) if k == 0 or _begins_sentence(text, spans[k].start)]

    def weigh(at: int) -> tuple[int, int]:
        inside = [h for h in hits if at <= h[0] < at + width]
        seen = {p for _, p, _ in inside}
        score = 1000 * len(seen) + len(inside) - len(seen)
        if not inside:
            return score, at
        first, last = inside[0][0], inside[-1][0] + inside[-1][2]
        centred = first - int((width - (last - first)) / 2)
        return score, max(0, min(centred, n - width))

    best, begin = 0, 0
    for pos, _, _ in hits:
        score, at = weigh(pos)
        if score > best:
            best, begin = score, at
        if n > width:
            before = [s for s in starts if s <= pos]
            if before and before[-1] < pos:
                score = weigh(before[-1])[0] + (120 if before[-1] == 0 else 100)
                if score > best:
                    best, begin = score, before[-1]
    end = min(n, begin + width)
    # Hits that touch or overlap are shown as one.
    marks: list[list[int]] = []
    for pos, _, size in hits:
        if marks and pos <= marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], pos + size - 1)
        else:
            marks.append([pos, pos + size - 1])
    out, at = ["..."] if begin > 0 else [], spans[begin].start if n and begin else 0
    for first, last in marks:
        if first < begin or first >= end:
            continue
        last = min(last, end - 1)
        out += [text[at : spans[first].start], "[", text[spans[first].start : spans[last].end], "]"]
        at = spans[last].end
    if end < n:
        out += [text[at : spans[end - 1].end], "..."]
    else:
        out.append(text[at:])
    return "".join(out)


def _begins_sentence(text: str, at: int) -> bool:
    before = text[:at].rstrip(" \t\n\r")
    return len(before) < at and before.endswith((".", ":"))


def marked_runs(shown: str) -> list[tuple[str, bool]]:
    """A snippet as its runs: (text, is it a hit?)."""
    parts = re.split(r"\[([^\]]*)\]", shown)
    return [(p, k % 2 == 1) for k, p in enumerate(parts) if p]


def preview(text: str, start: int, end: int, size: int = PREVIEW) -> str:
    """The beginning of the chunk ``start`` to ``end``, from a whole word to a whole word, with an ellipsis on a side where
    the text goes on."""
    chunk = text[start:end]
    before = text[start - 1] if start > 0 else None
    if before is not None and not before.isspace():
        gap = re.search(r"\s", chunk)
        if gap:
            chunk, start = chunk[gap.end() :], start + gap.end()
    kept, rest = chunk[:size], chunk[size:]
    after = rest[:1] or text[start + len(chunk) : start + len(chunk) + 1]
    if after and not after.isspace():
        gaps = [m.start() for m in re.finditer(r"\s", kept) if m.start() > 0]
        if gaps:
            kept = kept[: gaps[-1]]
    shown = " ".join(kept.split())
    return ("…" if before is not None and before != "\n" else "") + shown + ("…" if after else "")
