"""DuckDB SQL of the lexical levels and the like, built from the same word lists."""

from __future__ import annotations

from textloom.config import at_least
from textloom.functions import dicts


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str, options: str = "gi") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to.replace(chr(92), chr(92) * 2))}, '{options}')"


def words(many: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(many)})\b"


def dictionary(expr: str, entries: dict[str, str]) -> str:
    """One pattern after another, in order."""
    for k, v in entries.items():
        expr = sub(expr, rf"\b{k}\b", v)
    return expr


def tidy(expr: str) -> str:
    return sub(sub(sub(expr, r"[ \t]{2,}", " ", "g"), r"\n{3,}", "\n\n", "g"), r"^\s+|\s+$", "", "g")


def lexical(expr: str, mode: str) -> str:
    expr = sub(expr, words(dicts.FILLERS), "")
    expr = sub(expr, words(dicts.PLEASANTRIES) + r"[,.]?\s*", "")
    if at_least(mode, "standard"):
        expr = sub(expr, words(dicts.HEDGES) + r"\s*", "")
        expr = sub(expr, rf"(?m)^(?:{'|'.join(dicts.OPENERS)})\s+", "")
        expr = f"regexp_replace({expr}, '\\b(?:(?:a|an|the)\\s+)+([a-z])', '\\1', 'gi')"
    if at_least(mode, "aggressive"):
        expr = dictionary(expr, dicts.ABBREVIATIONS)
    if at_least(mode, "brutal"):
        expr = dictionary(expr, dicts.BRUTAL)
    if at_least(mode, "oblivion"):
        expr = rf"array_to_string(list_transform(regexp_extract_all({expr}, '(?s)\w+|\W+'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z]{{4,}}') THEN x[1] || regexp_replace(x[2:], '[aeiouAEIOU]', '', 'g') ELSE x END), '')"
    return tidy(expr)


def length16(expr: str) -> str:
    return f"length({expr})"


def estimate_tokens(expr: str) -> str:
    east = f"len(regexp_extract_all({expr}, '[\\x{{3000}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7ff}}]'))"
    return f"ceil({east} / 6 + (length({expr}) - {east}) / 3.5)::BIGINT"


def compressed(expr: str, mode: str) -> str:
    """The whole pipeline for prose, in which nothing is special and nothing Asian."""
    return f"CASE WHEN length({expr}) >= 50 THEN {dictionary(lexical(expr, mode), dicts.ENGLISH)} ELSE {expr} END"
