"""Settings and provider configuration of a job, with checks and defaults. Keys of providers never enter a table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from .functions.rewriting import PRESETS, preset_for_level


@dataclass(frozen=True)
class Settings:
    """What a job reads; a value of another type or outside its bounds is an error."""

    preset: str = "balanced"
    tier0_preview: bool = False
    tier1_preview: bool = True
    cloud_fallback: bool = False
    target: float = 0.5
    disclosure_seen: bool = False

    def __post_init__(self) -> None:
        if self.preset not in PRESETS:
            raise ValueError(f"no preset {self.preset!r}")
        if isinstance(self.target, bool) or not isinstance(self.target, (int, float)) or not 0.1 <= self.target <= 0.9:
            raise ValueError("target must lie between 0.1 and 0.9")
        for f in fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name} must be true or false")

    def with_(self, **values: Any) -> Settings:
        return replace(self, **values)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def read_settings(text: str | None) -> Settings:
    """Settings from JSON; what is missing has its default. An old level of aggressiveness (2 was the default once, 3 is)
    becomes a preset where none is named; names that are not known are ignored."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    level = found.get("aggressiveness")
    if level is not None and "preset" not in found:
        found["preset"] = preset_for_level(3 if level == 2 else level)
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in known})


@dataclass(frozen=True)
class Provider:
    name: str
    base_url: str
    model: str
    renewable: bool = True
    key: str = ""


def read_providers(text: str | None, default: list[Provider]) -> list[Provider]:
    """Providers from JSON, {"providers": [...]}; the default where that is missing or malformed."""
    try:
        rows = json.loads(text)["providers"] if text else None
        return [Provider(**{f.name: r[f.name] for f in fields(Provider) if f.name in r}) for r in rows] if isinstance(rows, list) else list(default)
    except (ValueError, KeyError, TypeError):
        return list(default)


def write_providers(providers: list[Provider]) -> str:
    return json.dumps({"providers": [asdict(p) for p in providers]})


def provider_rows(providers: list[Provider]) -> list[tuple]:
    """(provider, position, model, renewable, has_key) for a table: whether there is a key, never the key."""
    return [(p.name, i, p.model, p.renewable, bool(p.key)) for i, p in enumerate(providers)]
