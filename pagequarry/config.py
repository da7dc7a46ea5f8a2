"""Settings from a KEY=VALUE file and the environment; the environment wins."""

from __future__ import annotations

import os
import re
from pathlib import Path


def read_file(path: str | Path) -> dict[str, str]:
    values = {}
    file = Path(path)
    for line in file.read_text("utf-8").splitlines() if file.exists() else ():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            values[key.strip()] = re.sub(r"\\(.)", r"\1", value[1:-1]) if quoted else value
    return values


def write_value(path: str | Path, key: str, value: str | None) -> None:
    """Set or replace a key; None removes it."""
    file = Path(path)
    lines = file.read_text("utf-8").splitlines() if file.exists() else []
    kept = [x for x in lines if x.split("=", 1)[0].strip() != key]
    if value is not None:
        escaped = value.replace("\\", "\\\\").replace('"', '\\"')
        kept.append(f'{key}="{escaped}"')
    file.write_text("".join(x + "\n" for x in kept), "utf-8")


class Settings:
    def __init__(self, path: str | Path = ".env", environment: dict[str, str] | None = None):
        self.values = read_file(path) | dict(os.environ if environment is None else environment)

    def has(self, key: str) -> bool:
        return bool(self.values.get(key, "").strip())

    def text(self, key: str, default: str = "") -> str:
        return self.values.get(key, "").strip() or default

    def number(self, key: str, default: float, least: float | None = None) -> float:
        try:
            n = type(default)(self.values.get(key, ""))
        except ValueError:
            n = default
        return n if least is None else max(least, n)

    def flag(self, key: str, default: bool = False) -> bool:
        v = self.values.get(key, "").strip().lower()
        return default if not v else v in ("1", "true", "yes", "on")
