"""The query language: words, "phrases", prefixes*, AND, OR, NOT; and groups of spellings.

A query is read into parts, parts into an expression, and an expression into Column conditions over how often each
phrase occurs in a row. Neighbours bind tighter than NOT, NOT tighter than AND, AND tighter than OR; a group of
spellings next to another term is tied to it by AND, which binds looser than NOT.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.excerpts import token_spans

# Spellings of one term, a group on each line.
SPELLINGS = """
dhamma, dharma
kamma, karma
nibbana, nirvana
sutta, sutra
bhikkhu, bhiksu
bhikkhuni, bhiksuni
sangha, samgha
tanha, trsna
khandha, skandha
sankhara, samskara
sati, smrti
vinnana, vijnana
panna, prajna
metta, maitri
magga, marga
anatta, anatman
dukkha, duhkha
arahant, arhat
jhana, dhyana
kilesa, klesa
asava, asrava
upekkha, upeksa
viriya, virya
bodhisatta, bodhisattva
thera, sthavira
paticcasamuppada, pratityasamutpada
patimokkha, pratimoksa
"""
# Letters of transliterated texts, and the plain ones that groups are written in.
_MARKED, _PLAIN = "āīūṛṝḷḹēōṅñṇṭḍśṣṃṁḥ", "aiurrlleonnntdssmmh"


def fold_spelling(term: str) -> str:
    """As groups are looked up: lower case, the letters of transliteration plain, other letters as they are."""
    table = str.maketrans(_MARKED, _PLAIN, "".join(map(chr, range(0x300, 0x370))))
    return term.lower().translate(table)


class Spellings:
    """Groups of terms that stand for one another."""

    def __init__(self, text: str = ""):
        self.groups: list[list[str]] = []
        self.of: dict[str, int] = {}
        for line in text.splitlines():
            terms = [t for t in (fold_spelling(x.strip()) for x in line.split("#")[0].split(",")) if t]
            if len(terms) < 2:
                continue
            for t in terms:
                if t in self.of:
                    raise ValueError(f"{t!r} is in two groups")
                self.of[t] = len(self.groups)
            self.groups.append(terms)

    def group(self, word: str) -> list[str] | None:
        at = self.of.get(fold_spelling(word))
        return None if at is None else self.groups[at]


@functools.cache
def bundled() -> Spellings:
    return Spellings(SPELLINGS)


@dataclass(frozen=True)
class Part:
    """A term (``texts`` of one), a group of spellings (several), or an operator."""

    texts: tuple[str, ...] = ()
    prefix: bool = False
    operator: str = ""


def read(query: str, spellings: Spellings | None = None) -> list[Part]:
    """The parts of a query. Quotes without a partner, parentheses and the like are text; operators are upper case and
    stand between terms."""
    spellings = bundled() if spellings is None else spellings
    parts: list[Part] = []
    k, n, term_before = 0, len(query), False
    while k < n:
        if query[k].isspace():
            k += 1
            continue
        closing = query.find('"', k + 1) if query[k] == '"' else -1
        if closing > 0:
            text, k = query[k + 1 : closing], closing + 1
            prefix = query.startswith("*", k)
            k += prefix
            phrase = True
        else:
            start = k
            k += 1
            while k < n and not query[k].isspace() and not (query[k] == '"' and '"' in query[k + 1 :]):
                k += 1
            text, phrase = query[start:k], False
            if text in ("AND", "OR", "NOT") and term_before:
                parts.append(Part(operator=text))
                term_before = False
                continue
            prefix = text.endswith("*")
            text = text.rstrip("*") if prefix else text
        if not text.strip():
            continue
        group = None if phrase or prefix else spellings.group(text)
        parts.append(Part(tuple(group) if group else (text,), prefix))
        term_before = True
    if parts and not term_before:
        parts.pop()
    return parts


def written(parts: list[Part]) -> str | None:
    """The parts as an explicit query: terms quoted, groups in parentheses and tied by AND to the terms beside them."""
    out = ""
    for k, p in enumerate(parts):
        quoted = ['"' + t.replace('"', '""') + '"' for t in p.texts]
        shown = p.operator or ("(" + " OR ".join(quoted) + ")" if len(quoted) > 1 else quoted[0] + "*" * p.prefix)
        if k:
            before = parts[k - 1]
            tied = not p.operator and not before.operator and (len(p.texts) > 1 or len(before.texts) > 1)
            out += " AND " if tied else " "
        out += shown
    return out or None


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row; the last may be the beginning of one."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    """``phrase`` (number), ``and``, ``or``, ``not`` or ``none``, which matches nothing."""

    kind: str
    children: tuple[Node, ...] = ()
    phrase: int = -1


@dataclass
class Query:
    """A query's expression and its phrases, in order; a word that is there twice is two phrases."""

    root: Node | None
    phrases: list[Phrase] = field(default_factory=list)

    def matches(self, counts: list[Column]) -> Column:
        """Does a row match, in which the phrases occur so often?"""
        return _holds(self.root, counts)

    def contributing(self, counts: list[Column]) -> list[Column]:
        """For each phrase: does it take part in the match? What is under NOT does not, nor does an alternative that does
        not match by itself."""
        out: list[Column] = [F.lit(False)] * len(self.phrases)

        def walk(node: Node, given: Column) -> None:
            given = given & _holds(node, counts)
            if node.kind == "phrase":
                out[node.phrase] = given
            elif node.kind in ("and", "or"):
                for child in node.children:
                    walk(child, given)
            elif node.kind == "not":
                walk(node.children[0], given)

        walk(self.root, F.lit(True))
        return out


def _holds(node: Node, counts: list[Column]) -> Column:
    if node.kind == "none":
        return F.lit(False)
    if node.kind == "phrase":
        return counts[node.phrase] > 0
    of = [_holds(c, counts) for c in node.children]
    if node.kind == "not":
        return of[0] & ~of[1]
    out = of[0]
    for c in of[1:]:
        out = out & c if node.kind == "and" else out | c
    return out


def compile_query(query: str, spellings: Spellings | None = None, token=None) -> Query | None:
    """The expression of a query, or None if there is nothing in it to search for. ``token`` maps a query's tokens to
    the index's (stems them, say)."""
    parts = read(query, spellings)
    if not parts:
        return None
    out = Query(None)

    def phrase(text: str, prefix: bool) -> Node:
        terms = tuple(token(s.term) if token else s.term for s in token_spans(text))
        if not terms:
            return Node("none")
        out.phrases.append(Phrase(terms, prefix))
        return Node("phrase", phrase=len(out.phrases) - 1)

    # Runs of neighbours first; a group stands by itself.
    items: list[Node | str] = []
    run: list[Node] = []

    def close() -> None:
        if run:
            some = [r for r in run if r.kind != "none"]
            node = some[0] if some else Node("none")
            for r in some[1:]:
                node = Node("and", (node, r))
            items.append(node)
            run.clear()

    for k, p in enumerate(parts):
        if p.operator:
            close()
            items.append(p.operator)
            continue
        if len(p.texts) > 1:
            if k and not parts[k - 1].operator:
                close()
                items.append("AND")
            group = phrase(p.texts[0], False)
            for t in p.texts[1:]:
                group = Node("or", (group, phrase(t, False)))
            items.append(group)
        else:
            if k and len(parts[k - 1].texts) > 1:
                items.append("AND")
            run.append(phrase(p.texts[0], p.prefix))
    close()
    for operator, kind in (("NOT", "not"), ("AND", "and"), ("OR", "or")):
        done: list[Node | str] = []
        k = 0
        while k < len(items):
            if items[k] == operator:
                done[-1] = Node(kind, (done[-1], items[k + 1]))
                k += 2
            else:
                done.append(items[k])
                k += 1
        items = done
    out.root = items[0]
    return out
