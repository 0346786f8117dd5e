"""The passes that can't be expressions, in one visit to a text: JSON, protected blocks and all that must see the text
with the blocks taken out. Rows go through here only if something in them calls for it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby
from math import ceil, log

from textloom.config import EngineConfig, at_least
from textloom.functions import dicts, redact
from textloom.functions.json_shred import length16, shred
from textloom.functions.languages import CHINESE
from textloom.functions.reduce import CODE_FILE, CODE_LINE, FRAME, IMPORT, SIGNATURES
from textloom.functions.text import LINE, SPACE, SPACES, any_of, word, words

#: What is kept out of the passes, in order; later kinds may hold earlier ones. Fixed values.
PROTECTED = (r"```[\s\S]*?```", r"`[^`\n]+`", r"\[[^\]]+\]\([^)]+\)", rf"(?i)(?<![A-Za-z0-9_])https?://[^{SPACES}]+")
BASE64 = r"[A-Za-z0-9+/]{80,}={0,2}"
PATH = rf"(?:[A-Z]:\\(?:[^\\{SPACES}]+\\)+|(?:/(?:[^{SPACES}/]+/)+))([^{SPACES}/\\]+(?:\.[^{SPACES}\\/]+)?)"
LONGEST_PATH = 30
SEPARATORS = rf"([=\-*_]){{3,}}(?:{SPACE}*\1{{3,}}){{2,}}"


@lru_cache(maxsize=512)
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def trim(text: str) -> str:
    return _re(rf"\A{SPACE}+|{SPACE}+\Z").sub("", text)


class Blocks:
    """Protected blocks taken out of a text and put back."""

    def __init__(self, text: str, patterns: tuple[str, ...] = PROTECTED):
        self.held: list[str] = []
        for p in patterns:
            text = _re(p).sub(self._hold, text)
        self.text = text

    def _hold(self, m: re.Match) -> str:
        self.held.append(m[0])
        return f"\0PROT{len(self.held) - 1}\0"

    def restore(self, text: str) -> str:
        """Last ones first, as they may hold marks of earlier ones; each mark once."""
        for i in reversed(range(len(self.held))):
            before, mark, after = text.partition(f"\0PROT{i}\0")
            text = before + self.held[i] + after if mark else text
        return text


def mark_base64(text: str) -> str:
    return _re(BASE64).sub(lambda m: f"[BASE64:{len(m[0])}ch]", text)


def redact_secrets(text: str) -> str:
    for marker, pattern in redact.SECRETS:
        text = _re(pattern).sub(marker, text)
    return text


def compact_paths(text: str) -> str:
    return _re(PATH).sub(lambda m: f"...{m[1]}" if length16(m[0]) > LONGEST_PATH else m[0], text)


def collapse_separators(text: str) -> str:
    return _re(SEPARATORS).sub(lambda m: f"{m[1] * 3}\n[{m[1]} lines collapsed]", text)


def is_likely_code(text: str) -> bool:
    lines = text.split("\n")
    return length16(text) >= 100 and sum(bool(_re(CODE_LINE).match(x)) for x in lines) / len(lines) > 0.30


def skeleton(text: str, name: str) -> str:
    lines, kept = text.split("\n"), []
    for x in lines if length16(text) >= 500 else []:
        if _re(IMPORT).match(x):
            kept.append(x)
        elif any(_re(p).match(x) for p in SIGNATURES):
            stub = ["  ..."] if "{" not in x and ":" not in x else ["  ...", "}"] if "{" in x and "}" not in x else []
            kept += [x, *stub]
    if len(kept) < 3:
        return text
    return "\n".join((f"[SKELETON: {name} | {len(kept)} signatures from {len(lines)} lines]", *kept, "[Use read_function_body or read_file_range for full impl]"))


def sentences(text: str) -> list[str]:
    return re.findall(r"[^.!?]+[.!?]+", text)


def best_sentences(text: str, ratio: float) -> list[str] | None:
    """The share of sentences with the highest sums of tf-idf, in their order; None for a text with too little of them."""
    own = sentences(text)
    if length16(text) < 500 or len(own) < 5:
        return None
    bags = [Counter(w for w in re.findall(r"\w+", s.lower(), re.ASCII) if w not in dicts.STOP_WORDS) for s in own]
    held = Counter(w for b in bags for w in b)
    score = [round(sum(n * log(len(own) / held[w]) for w, n in b.items()), 9) for b in bags]
    best = sorted(range(len(own)), key=lambda i: (-score[i], i))[: max(1, ceil(len(own) * ratio))]
    return [trim(own[i]) for i in sorted(best)]


def distil(text: str, ratio: float) -> str:
    """Those sentences, or the text as it is."""
    best = best_sentences(text, ratio)
    return text if best is None else " ".join(best)


def slim_stack_trace(text: str) -> str:
    first, *rest = text.split("\n")
    out = [first]
    for framed, run in groupby(rest, lambda x: bool(_re(FRAME).match(x))):
        run = list(run)
        out += [*run[:3], f"  [{len(run) - 5} frames omitted]", *run[-2:]] if framed and len(run) >= 6 else run
    return "\n".join(out)


def halve_indents(text: str) -> str:
    half = _re(r"(?<![^\n\r\u2028\u2029])[ \t]+").sub(lambda m: " " * (len(m[0]) // 2), text)
    return re.sub(r"\n{3,}", "\n\n", half)


def _dictionary(entries: dict[str, str]) -> list[Callable[[str], str]]:
    one, many = dicts.singles(entries), dicts.phrases(entries)
    steps: list[Callable[[str], str]] = [lambda t, p=_re(word(k)), v=v: p.sub(lambda _: v, t) for k, v in many.items()]
    if one:
        steps.insert(0, lambda t, p=_re(word(any_of(list(one)))): p.sub(lambda m: one[m[0].lower()], t))
    return steps


def _vowels(m: re.Match) -> str:
    return m[0][0] + re.sub("[aeiouAEIOU]", "", m[0][1:])


def lexical_steps(mode: str, cfg: EngineConfig) -> list[Callable[[str], str]]:
    gone = lambda pattern: lambda t: _re(pattern).sub("", t)
    steps = [gone(words(dicts.FILLERS)), gone(words(dicts.PLEASANTRIES) + f"[,.]?{SPACE}*")]
    if at_least(mode, "standard"):
        steps += [gone(words(dicts.HEDGES) + f"{SPACE}*"), gone(f"(?i){LINE}(?:{'|'.join(dicts.OPENERS)}){SPACE}+"), gone(f"{words(dicts.ARTICLES)}{SPACE}+(?=[A-Za-z])")]
    if at_least(mode, "aggressive"):
        steps += _dictionary(dicts.ABBREVIATIONS | dict(cfg.abbreviations))
    if at_least(mode, "brutal"):
        steps += reversed_words(dicts.BRUTAL | dict(cfg.brutal_replacements))
    if at_least(mode, "oblivion"):
        steps.append(lambda t: _re(r"(?<![A-Za-z0-9_])[A-Za-z]{4,}(?![A-Za-z0-9_])").sub(_vowels, t))
    return steps


def reversed_words(entries: dict[str, str]) -> list[Callable[[str], str]]:
    """Phrases before words."""
    first, *rest = _dictionary(entries)
    return [*rest, first]


@lru_cache(maxsize=16)
def _steps(mode: str, abbreviations: tuple, brutal: tuple) -> list[Callable[[str], str]]:
    return lexical_steps(mode, EngineConfig(abbreviations=dict(abbreviations), brutal_replacements=dict(brutal)))


def language_pass(text: str, cfg: EngineConfig) -> str:
    """As the expression of the same name."""
    head = text[:500]
    if len(re.findall(r"[\u3040-\u30ff]", head)) > 5:
        for k, v in dicts.JAPANESE.items():
            text = text.replace(k, v)
        return text
    if len(re.findall(r"[\u4e00-\u9fff]", head)) > 10:
        for particle, ahead in CHINESE:
            text = re.sub(particle + ahead, "", text)
        return text
    local = dict(cfg.indonesian) if cfg.indonesian is not None else dicts.INDONESIAN
    entries = local if len(_re(words(dicts.INDONESIAN_MARKS)).findall(head)) >= 3 else dicts.ENGLISH
    for step in _dictionary(entries):
        text = step(text)
    return text


def compress(text: str, original: str, mode: str, cfg: EngineConfig, name: str | None = None) -> str:
    """From JSON to restored blocks. `original` is the text before any pass."""
    text = shred(text)[0] or ""
    blocks = Blocks(text)
    out = compact_paths(redact_secrets(mark_base64(blocks.text)))
    file = name is not None and re.search(CODE_FILE, name) is not None
    code = file or is_likely_code(out)
    if cfg.skeleton and file:
        out = skeleton(out, name)
    if cfg.distill and not code:
        out = distil(out, cfg.distill_ratio)
    if code and "```" not in original:
        out = halve_indents(out)
    out = collapse_separators(slim_stack_trace(out))
    for step in _steps(mode, tuple(cfg.abbreviations.items()), tuple(cfg.brutal_replacements.items())):
        out = step(out)
    out = trim(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", out)))
    return blocks.restore(language_pass(out, cfg) if cfg.strict_protect else out)


# --- functions and classes by name -------------------------------------------------------------------------------

_STRINGS = re.compile(r"""\\.|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|//.*|`.*|[{}]""", re.S)


def braces(line: str) -> tuple[int, int]:
    """Opening and closing braces outside quotes, and before a line comment or a backtick."""
    found = [m for m in _STRINGS.findall(line) if m in "{}"]
    return found.count("{"), found.count("}")


def function_body(code: str, name: str, function: str) -> str:
    """The lines from a function's or class's first to where its braces close."""
    if not code:
        return "[ERROR] File is empty."
    s = SPACE
    head = _re(
        rf"(?:\A|{s})(?:export{s}+)?(?:default{s}+)?(?:async{s}+)?(?:function{s}*\*?{s}+|class{s}+|const{s}+|let{s}+|var{s}+|def{s}+|func{s}+|fn{s}+|pub{s}+(?:async{s}+)?fn{s}+)?{re.escape(function)}{s}*[=({{:]"
    )
    lines = code.split("\n")
    start = next((i for i, x in enumerate(lines) if head.search(x)), None)
    if start is None:
        return f"[SNIPER ERROR] '{function}' not found in {name}.\nTip: check exact name with grep_files tool."
    depth, end = 0, len(lines)
    for i in range(start, len(lines)):
        opened, closed = braces(lines[i])
        depth += opened - closed
        if (i > start and depth <= 0) or (i == start and depth == 0 and ("=>" in lines[i] or "def " in lines[i])):
            end = i + 1
            break
    return f"[SNIPER: {name} → {function} | {end - start} lines]\n" + "\n".join(lines[start:end])
