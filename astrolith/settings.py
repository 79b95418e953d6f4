"""Settings in a JSON file; what cannot be read falls back to the defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

MIN_TIMEOUT_MS = 1000


@dataclass
class Settings:
    provider: str = ""
    timeout_ms: int = 120_000
    cache_dir: str = ""
    bind: str = "127.0.0.1"
    port: int = 8080


def path() -> str:
    return os.path.join(os.path.expanduser("~"), ".astrolith", "settings.json")


def load(file: str | None = None) -> Settings:
    out = Settings()
    try:
        with open(file or path(), encoding="utf-8") as f:
            given = json.load(f)
        for x in fields(Settings):
            if isinstance(given.get(x.name), type(getattr(out, x.name))):
                setattr(out, x.name, given[x.name])
    except (OSError, ValueError, AttributeError):
        return Settings()
    out.timeout_ms = max(MIN_TIMEOUT_MS, out.timeout_ms)
    return out


def save(settings: Settings, file: str | None = None) -> None:
    target = file or path()
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
