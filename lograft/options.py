"""The options of every operator, as one immutable value."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any
from zoneinfo import ZoneInfo

from lograft.tables import COLOR_CODES, LEVEL_NAMES, LEVEL_NUMBERS, ROLE_ALIASES, ROLES

DEFAULT_TIMESTAMP_FORMAT = "%Y-%m-%dT%H:%M:%S%.3f"

_LEVEL_OF_NAME = {name: level for level, names in LEVEL_NAMES.items() for name in names}


class OptionError(ValueError):
    """An option value that cannot be used."""


def _known_levels(mapping: Mapping[str, str] | None) -> dict[str, str]:
    """Lower-cased custom names whose target is a known level; the others are ignored."""
    return {
        name.lower(): _LEVEL_OF_NAME[target.lower()]
        for name, target in (mapping or {}).items()
        if target.lower() in _LEVEL_OF_NAME
    }


def _known_colors(mapping: Mapping[str, str] | None) -> dict[str, str]:
    """Level -> colour for the entries whose level and colour are both known."""
    return {
        _LEVEL_OF_NAME[level.lower()]: color.lower()
        for level, color in (mapping or {}).items()
        if level.lower() in _LEVEL_OF_NAME and color.lower() in COLOR_CODES
    }


@dataclass(frozen=True)
class LogOptions:
    min_level: str | None = None
    grep: str | None = None
    timestamp_key: str | None = None
    level_key: str | None = None
    message_key: str | None = None
    logger_key: str | None = None
    caller_key: str | None = None
    error_key: str | None = None
    include_fields: tuple[str, ...] | None = None
    exclude_fields: tuple[str, ...] | None = None
    no_extra: bool = False
    max_field_length: int = 120
    timestamp_format: str = DEFAULT_TIMESTAMP_FORMAT
    timezone: str = "UTC"
    level_aliases: Mapping[str, str] | None = None
    level_colors: Mapping[str, str] | None = None
    line_gap: int = 1
    key_min_width: int = 25
    single_line: bool = False
    json_output: bool = False
    verbose: bool = False
    ansi: bool = False
    max_continuation_lines: int = 200

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.min_level is not None:
            level = self.min_level.lower()
            if level not in LEVEL_NUMBERS:
                raise OptionError(
                    f"invalid level {self.min_level!r}: expected one of {', '.join(LEVEL_NUMBERS)}"
                )
            put("min_level", level)
        for name in ("include_fields", "exclude_fields"):
            value = getattr(self, name)
            if isinstance(value, str):
                value = value.split(",")
            put(name, None if value is None else tuple(value))
        chosen = [
            name
            for name in ("include_fields", "exclude_fields", "no_extra")
            if getattr(self, name) not in (None, False)
        ]
        if len(chosen) > 1:
            raise OptionError(f"options exclude each other: {', '.join(chosen)}")
        for name in ("max_field_length", "line_gap", "key_min_width", "max_continuation_lines"):
            if getattr(self, name) < 0:
                raise OptionError(f"{name} must not be negative")
        if self.timezone.lower() not in ("utc", "local"):
            try:
                ZoneInfo(self.timezone)
            except Exception as problem:
                raise OptionError(f"invalid timezone {self.timezone!r}") from problem
        put("level_aliases", _known_levels(self.level_aliases))
        put("level_colors", _known_colors(self.level_colors))

    @classmethod
    def layered(cls, settings: Mapping[str, Any] | None = None, **explicit: Any) -> LogOptions:
        """Explicit options over a settings mapping over the defaults.

        ``settings`` may hold the nested groups ``keys``, ``levels`` and ``colors``. A time zone
        or level that is unusable there is ignored; given explicitly it is an error.
        """
        merged: dict[str, Any] = {}
        known = {f.name for f in fields(cls)}
        for name, value in (settings or {}).items():
            if name == "keys":
                merged.update({f"{role}_key": key for role, key in value.items() if role in ROLES})
            elif name == "levels":
                merged["level_aliases"] = value
            elif name == "colors":
                merged["level_colors"] = value
            elif name == "level":
                merged["min_level"] = _LEVEL_OF_NAME.get(value.lower())
            elif name == "timezone":
                try:
                    merged[name] = cls(timezone=value).timezone
                except OptionError:
                    pass
            elif name in known:
                merged[name] = value
        merged.update({name: value for name, value in explicit.items() if value is not None})
        return cls(**merged)

    def keys_of(self, role: str) -> tuple[str, ...]:
        """Names tried for a role: the custom key alone if there is one, else the aliases."""
        custom = getattr(self, f"{role}_key")
        return ROLE_ALIASES[role] if custom is None else (custom,)

    @property
    def min_level_number(self) -> int | None:
        return None if self.min_level is None else LEVEL_NUMBERS[self.min_level]
