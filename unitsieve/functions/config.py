"""User configuration and the folders it lives in."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

_DEFAULTS = {"config": ("XDG_CONFIG_HOME", ".config"), "cache": ("XDG_CACHE_HOME", ".cache"), "data": ("XDG_DATA_HOME", ".local/share"), "state": ("XDG_STATE_HOME", ".local/state")}
APP = "unitsieve"


@dataclass(frozen=True)
class Config:
    color: str = "auto"
    threads: int = 0
    ignore: tuple[str, ...] = ()


def base_folder(kind: str, env: dict[str, str] | None = None) -> str:
    """The folder of this program; a relative value in the environment is ignored."""
    env = dict(os.environ) if env is None else env
    variable, default = _DEFAULTS[kind]
    value = env.get(variable, "")
    base = value if os.path.isabs(value) else os.path.join(env.get("HOME") or os.path.expanduser("~"), default)
    return os.path.join(base, APP)


def load(path: str | None = None) -> Config:
    """The configuration file; defaults where there is none."""
    path = path or os.path.join(base_folder("config"), "config.toml")
    try:
        with open(path, "rb") as f:
            values = tomllib.load(f)
    except FileNotFoundError:
        return Config()
    return Config(str(values.get("color", "auto") or "auto"), int(values.get("threads", 0)), tuple(values.get("ignore", ())))
