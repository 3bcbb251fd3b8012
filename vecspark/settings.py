"""Settings from the environment, each checked when read."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "VECSPARK_"


def flag(name: str, text: str) -> bool:
    found = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}.get(text.strip().lower())
    if found is None:
        raise ValueError(f"{name} must be a yes or a no, not {text!r}")
    return found


def positive_int(name: str, text: str) -> int:
    if not text.strip().isdecimal() or int(text) < 1:
        raise ValueError(f"{name} must be a whole number above zero, not {text!r}")
    return int(text)


def finite(name: str, text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number, not {text!r}")
    return value


def positive(name: str, text: str) -> float:
    if (value := finite(name, text)) <= 0:
        raise ValueError(f"{name} must be above zero, not {text!r}")
    return value


@dataclass(frozen=True)
class Settings:
    uploads: bool = True
    floor: float = 0.09
    max_title: int = 200
    max_text: int = 1_000_000
    max_question: int = 2000
    answer_timeout: float = 30.0
    max_body: int = 2_000_000

    PARSERS = {"uploads": flag, "floor": finite, "max_title": positive_int, "max_text": positive_int, "max_question": positive_int, "answer_timeout": positive, "max_body": positive_int}

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> "Settings":
        """What the environment sets; blank or missing variables keep the defaults."""
        env = os.environ if env is None else env
        names = {k: PREFIX + k.upper() for k in cls.PARSERS}
        return cls(**{k: cls.PARSERS[k](name, env[name]) for k, name in names.items() if env.get(name, "").strip()})


class TooLarge(ValueError):
    pass


def guarded(chunks, declared: int | None = None, settings: Settings = Settings()) -> bytes:
    """A request's body from its parts: raises as soon as what is declared or has come exceeds the limit."""
    if declared is not None and declared > settings.max_body:
        raise TooLarge(f"{declared} bytes are declared, {settings.max_body} are allowed")
    body = bytearray()
    for part in chunks:
        body += part
        if len(body) > settings.max_body:
            raise TooLarge(f"more than {settings.max_body} bytes")
    return bytes(body)


def health() -> dict[str, str]:
    return {"status": "ok"}
