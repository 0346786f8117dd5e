"""Text expressions: boundaries, spaces and lengths that mean the same in every engine.

Java's word boundary knows Unicode and its white space doesn't, so both are spelled out: a word is ASCII letters,
digits and underscore, and SPACE is every Unicode space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import dicts

#: Members of the class of all Unicode spaces.
SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Either side of a word, for patterns that may begin or end with another character.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: At the start of a line.
LINE = r"(?<![^\n\r\u2028\u2029])"


def word(pattern: str) -> str:
    """A case-blind pattern between ASCII word boundaries."""
    return f"(?i){BEGIN}(?:{pattern}){END}"


def phrase(text: str) -> str:
    """word() for a phrase that begins with a letter: that letter is compared first, which most places fail at once."""
    return f"(?i){text[0]}(?<![A-Za-z0-9_]{text[0]}){text[1:]}{END}"


def words(many: tuple[str, ...]) -> str:
    """word() for any of some patterns that begin with letters, which are looked at first."""
    first = "".join(sorted({x[0] for x in many}))
    return f"(?i)(?=[{first}]){BEGIN}(?:{'|'.join(many)}){END}"


def any_of(many: Iterable[str]) -> str:
    """A pattern for any of the strings, with common beginnings written once: engines try few branches at a place."""
    by: dict[str, list[str]] = {}
    for x in many:
        if x:
            by.setdefault(x[0], []).append(x[1:])
    parts = [re.escape(c) + any_of(rest) for c, rest in sorted(by.items())]
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 and "" not in many else f"(?:{'|'.join(parts)})"
    return whole + "?" * ("" in many)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c evaluated once, however often body uses it: without this, nested uses would multiply."""
    return F.element_at(F.transform(F.array(c), body), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def length16(c: Column) -> Column:
    """Length in UTF-16 units."""
    return let(c, lambda x: F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]")))


def estimate_tokens(c: Column) -> Column:
    """ceil(east / 6 + other / 3.5), east counting kana, Han and Hangul; 0 for null."""

    def tokens(x: Column) -> Column:
        east = F.regexp_count(x, F.lit(r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7ff}]"))
        return F.coalesce(F.ceil(east / 6 + (length16(x) - east) / 3.5), F.lit(0)).cast("long")

    return let(c, tokens)


def quarter_tokens(c: Column) -> Column:
    """ceil(length / 4), the reports' estimate."""
    return F.coalesce(F.ceil(length16(c) / 4), F.lit(0)).cast("long")


def round_binary(c: Column, places: int) -> Column:
    """Rounded as SQL engines do: the double is multiplied first. Spark's round() reads its shortest decimal, so that
    63.949999999999996 becomes 63.9 there and 64.0 here."""
    by = float(10**places)
    return F.round(c * by) / by


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def look_up(c: Column, entries: dict[str, str]) -> Column:
    """Whole ASCII words replaced by the entries, whatever their case; one pass over the text's words."""
    if not entries:
        return c
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    longest = max(map(len, entries))
    changed = lambda t: F.when(F.length(t) <= longest, F.coalesce(F.try_element_at(table, F.lower(t)), t)).otherwise(t)
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    known = word(any_of(list(entries)))
    return let(c, lambda x: F.when(x.rlike(known), F.array_join(F.transform(tokens(x), changed), "")).otherwise(x))


def replace_phrases(c: Column, entries: dict[str, str]) -> Column:
    """Phrases replaced one after another."""
    for k, v in entries.items():
        c = F.regexp_replace(c, phrase(k) if k[:1].isalpha() and k.isascii() else word(k), v.replace("\\", r"\\").replace("$", r"\$"))
    return c


def apply_dictionary(c: Column, entries: dict[str, str]) -> Column:
    """Words at once, then phrases in order."""
    return replace_phrases(look_up(c, dicts.singles(entries)), dicts.phrases(entries))
