"""The lexical levels: fillers, pleasantries, hedges, openers, articles, abbreviations, vowels, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import EngineConfig, at_least
from textloom.functions import dicts
from textloom.functions.text import LINE, SPACE, apply_dictionary, look_up, replace_phrases, trim, words


def drop_fillers(c: Column) -> Column:
    return F.regexp_replace(c, words(dicts.FILLERS), "")


def drop_pleasantries(c: Column) -> Column:
    return F.regexp_replace(c, words(dicts.PLEASANTRIES) + f"[,.]?{SPACE}*", "")


def drop_hedges(c: Column) -> Column:
    return F.regexp_replace(c, words(dicts.HEDGES) + f"{SPACE}*", "")


def drop_openers(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i)(?=[ilwy]){LINE}(?:{'|'.join(dicts.OPENERS)}){SPACE}+", "")


def drop_articles(c: Column) -> Column:
    return F.regexp_replace(c, f"{words(dicts.ARTICLES)}{SPACE}+(?=[A-Za-z])", "")


def abbreviate(c: Column, cfg: EngineConfig) -> Column:
    return apply_dictionary(c, dicts.ABBREVIATIONS | dict(cfg.abbreviations))


def replace_brutally(c: Column, cfg: EngineConfig) -> Column:
    """Phrases come first here: some hold words that are keys as well."""
    entries = dicts.BRUTAL | dict(cfg.brutal_replacements)
    return look_up(replace_phrases(c, dicts.phrases(entries)), dicts.singles(entries))


def drop_vowels(c: Column) -> Column:
    """Words of four letters or more, of letters only, keep their first letter and lose all other vowels."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    short = lambda t: F.when(t.rlike("^[A-Za-z]{4,}$"), F.concat(F.substring(t, 1, 1), F.translate(F.substring(t, 2, 1 << 30), "aeiouAEIOU", ""))).otherwise(t)
    return F.array_join(F.transform(tokens, short), "")


def tidy(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def lexical(c: Column, mode: str, cfg: EngineConfig | None = None) -> Column:
    """All lexical passes of a level, in order."""
    cfg = cfg or EngineConfig()
    c = drop_pleasantries(drop_fillers(c))
    if at_least(mode, "standard"):
        c = drop_articles(drop_openers(drop_hedges(c)))
    if at_least(mode, "aggressive"):
        c = abbreviate(c, cfg)
    if at_least(mode, "brutal"):
        c = replace_brutally(c, cfg)
    if at_least(mode, "oblivion"):
        c = drop_vowels(c)
    return tidy(c)

