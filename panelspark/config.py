"""Settings from the environment."""

from __future__ import annotations

import os

_YES, _NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def env_bool(name: str, default: bool = False) -> bool:
    """A switch; anything that is neither yes nor no gives the default."""
    v = os.environ.get(name)
    v = v.strip().lower() if v is not None else None
    return True if v in _YES else False if v in _NO else default


def env_int(name: str, default: int) -> int:
    """A whole number, the default if missing or unreadable."""
    try:
        return int(os.environ.get(name, "").strip())
    except ValueError:
        return default
