"""Settings of a run, from the environment on the driver alone, and its log."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    base_url: str = "https://site.example"
    retention_days: int = 90
    model_budget: float = 900.0
    model_key: str | None = None


def settings(env: dict[str, str] | None = None) -> Settings:
    """GAZETTE_BASE_URL, GAZETTE_RETENTION_DAYS, GAZETTE_MODEL_BUDGET, GAZETTE_MODEL_KEY; a bad number leaves its default."""
    env = dict(os.environ) if env is None else env

    def number(name: str, default):
        try:
            return type(default)(env.get(name, default))
        except ValueError:
            return default

    d = Settings()
    return Settings(env.get("GAZETTE_BASE_URL", d.base_url), number("GAZETTE_RETENTION_DAYS", d.retention_days), number("GAZETTE_MODEL_BUDGET", d.model_budget), env.get("GAZETTE_MODEL_KEY") or None)


def logger(name: str, path: str | None = None) -> logging.Logger:
    """Writes to the console and, if a path is given, to a file; a second call adds no handler."""
    log = logging.getLogger(f"gazette.{name}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        for h in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(h)
    return log
