"""Text functions as Column expressions: folding, tokens, white space, titles, page numbers.

All positions and lengths are in code points, as Spark's own ``length`` and ``substring`` count them.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token: a letter, number or private-use character, then such or marks.
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def plain_letters() -> tuple[str, str]:
    """Letters that are one letter and marks, and those letters; from the Unicode tables, Hangul aside."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and unicodedata.category(whole[0])[0] in "LN" and all(unicodedata.category(c)[0] == "M" for c in whole[1:]) and code < 0x10000:
            source.append(chr(code)), target.append(whole[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Without diacritics, in lower case."""
    return F.lower(F.regexp_replace(F.translate(text, *plain_letters()), r"\p{M}", ""))


@functools.cache
def _plain_table() -> dict[int, str]:
    return dict(zip(map(ord, plain_letters()[0]), plain_letters()[1], strict=True))


def fold_py(text: str) -> str:
    """As ``fold``, in Python."""
    if text.isascii():
        return text.lower()
    out = text.translate(_plain_table())
    return "".join(c for c in out if unicodedata.category(c)[0] != "M").lower()


def tokens(text: Column) -> Column:
    """The folded tokens of a text, in order. Marks that stand before any letter are no token."""
    # Folding drops marks, so they need no part in the pattern; one pass over the folded text finds all tokens.
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """In canonical composition (NFC), which no built-in function makes: for the few, short texts that are compared so."""
    return _composed(text)


def collapse(text: Column) -> Column:
    """Trimmed, with runs of (any) white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def collapse_or_null(text: Column) -> Column:
    """As ``collapse``; null if nothing is left."""
    return F.nullif(collapse(text), F.lit(""))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nocase(text: Column) -> Column:
    """Lower-cased in ASCII alone, as a NOCASE collation compares."""
    return F.translate(text, UPPER, LOWER)


def cut(text: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (excluded)."""
    return F.substring(text, start.cast("int") + 1, (stop - start).cast("int"))


def ends_like_sentence(text: Column) -> Column:
    """Does the text, white space aside, end as a sentence, clause or quotation does?"""
    return F.rtrim(F.regexp_replace(text, r"(?U)\s+$", "")).rlike(r"[.,;:!?\"'”’)\]»]$")


def matches_words(text: Column, query: str) -> Column:
    """Every word of ``query`` is in ``text``, in any order, whatever the accents and case; an empty query matches all."""
    out = F.lit(True)
    folded = fold(text)
    for word in fold_py(query).split():
        out = out & F.contains(folded, F.lit(word))
    return out


def shown_title(title: Column, author: Column) -> Column:
    """What a book is filtered by: its title and author, with the stand-ins for those that are not known."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("Untitled")), F.coalesce(author, F.lit("Unknown author")))


def without_article(title: Column) -> Column:
    return F.regexp_replace(title, r"(?i)^(the|an?)\s+", "")


def catalogue_key(text: Column) -> Column:
    """Sorts as a catalogue does: no leading article, accents and case aside, numbers by value."""
    padded = F.regexp_replace(fold(without_article(text)), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def percent_decode(text: Column) -> Column:
    """%XX as UTF-8; ``+`` stays, and what is no escape stays too."""
    # url_decode turns + into a space, so it is escaped first; lone % signs likewise.
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(safe)


def local_name(tag: Column) -> Column:
    """A tag without its prefix."""
    return F.substring_index(tag, ":", -1)


def tidy_stem(stem: Column) -> Column:
    """A file name made readable: ``_`` and ``-`` are spaces, and camel case is parted."""
    return collapse(F.regexp_replace(F.translate(stem, "_-", "  "), r"(?<=\p{Ll})(?=\p{Lu})", " "))


# What tools leave in place of a title.
JUNK_TITLES = ("untitled", "untitled document")
JUNK_PREFIXES = ("microsoft word - ", "microsoft powerpoint - ", "microsoft excel - ")
JUNK_ENDINGS = (".doc", ".docx", ".odt", ".rtf", ".txt", ".pdf", ".indd", ".qxd", ".tex", ".dvi")


def is_junk(text: Column) -> Column:
    """Does a title or author say nothing: no letters, a stand-in, a slide number, a tool's name or a file name?"""
    low = F.lower(text)
    endings = "|".join(e.replace(".", r"\.") for e in JUNK_ENDINGS)
    return ~text.rlike(r"\p{IsAlphabetic}") | low.isin(*JUNK_TITLES) | low.rlike(r"^slide [0-9]+$") | low.rlike("^(" + "|".join(JUNK_PREFIXES) + ")") | low.rlike(f"({endings})$")


#: Up to four digits, or a canonical roman numeral below 200 in one case.
_ROMAN = r"c?(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"
PAGE_NUMBER = rf"(\d{{1,4}}|(?=.){_ROMAN}|(?=.){_ROMAN.upper()})"


def is_page_number(word: Column) -> Column:
    return word.rlike(f"^{PAGE_NUMBER}$")


def running_key(line: Column) -> Column:
    """A line without a page number at either end, single-spaced; empty if nothing else is in it."""
    flat = collapse(line)
    no_first = F.regexp_replace(flat, rf"^{PAGE_NUMBER}( |$)", "")
    return F.regexp_replace(no_first, rf"(^| ){PAGE_NUMBER}$", "")


def percent(before: Column, total: Column, finished: Column) -> Column:
    """Whole percent, half up: 100 if finished, 0 if there is nothing to read."""
    return F.when(finished, F.lit(100)).when(total == 0, F.lit(0)).otherwise(F.floor((before * 200 + total) / (total * 2))).cast("bigint")


def list_phrase(count: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, F.lit(one)).otherwise(F.lit(many)))


def chapter_name(title: Column, idx: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Chapter "), (idx + 1).cast("string")))


def cover_tint(book_id: Column) -> Column:
    return F.pmod(book_id, F.lit(6)) + 1


def initial(title: Column) -> Column:
    return F.upper(F.substring(F.regexp_extract(title, r"[\p{L}\p{N}]", 0), 1, 1))


def relative_path(path: Column, folder: Column) -> Column:
    """A path below a folder, as it is shown: without the folder, and without a separator before it."""
    inside = path.startswith(folder)
    return F.when(inside, F.regexp_replace(F.substr(path, F.length(folder) + 1), r"^[/\\]+", "")).otherwise(path)
