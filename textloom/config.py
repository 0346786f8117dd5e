"""Settings, passed explicitly; nothing is global."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

#: Levels, mildest first.
MODES = ("lite", "standard", "aggressive", "brutal", "oblivion")


def at_least(mode: str, level: str) -> bool:
    return MODES.index(mode) >= MODES.index(level)


@dataclass(frozen=True)
class EngineConfig:
    """What a caller can set; the defaults are those of a run without a configuration file."""

    mode: str = "aggressive"
    redact_pii: bool = False
    skeleton: bool = False
    distill: bool = False
    distill_ratio: float = 0.3
    dedup_threshold: float = 0.8
    min_level: str = "lite"
    max_level: str = "brutal"
    alert_tokens: int = 50_000
    critical_tokens: int = 80_000
    #: Added to, or put in place of, the built-in entries of the same key.
    abbreviations: Mapping[str, str] = field(default_factory=dict)
    brutal_replacements: Mapping[str, str] = field(default_factory=dict)
    #: A whole dictionary in place of the short built-in one.
    indonesian: Mapping[str, str] | None = None
    #: Keep fenced code, links and addresses out of the language pass too, which by default sees them again.
    strict_protect: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.min_level not in MODES or self.max_level not in MODES:
            raise ValueError(f"levels are {', '.join(MODES)}")
