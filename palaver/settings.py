"""Settings from files, the environment and the session."""

from __future__ import annotations

import dataclasses
import os
import shlex
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


def env_file(text: str) -> dict[str, str]:
    """``NAME=value`` lines; ``export`` in front, quotes around and comments behind a value are dropped."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and name.strip() and not name.strip().startswith("#"):
            out[name.strip()] = " ".join(shlex.split(value, comments=True)) if value.strip() else ""
    return out


def load_env(paths: list[str | Path], environ: dict[str, str] | None = None) -> dict[str, str]:
    """The first file that is there, put into the environment where a name is not yet set."""
    environ = os.environ if environ is None else environ
    for path in map(Path, paths):
        if path.is_file():
            found = env_file(path.read_text(encoding="utf-8"))
            for name, value in found.items():
                environ.setdefault(name, value)
            return found
    return {}


def flag(value: str | None, default: bool = False) -> bool:
    """A switch: 1, true, yes and on are true, anything else is false; unset or blank is the default."""
    return default if value is None or not value.strip() else value.strip().lower() in ("1", "true", "yes", "on")


def options(kind: type[T], *sources: dict) -> T:
    """A dataclass filled from the sources, later ones first; texts become the field's type, unknown names are an error."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    values = {}
    for source in sources:
        for name, value in source.items():
            if name not in fields:
                raise ValueError(f"unknown setting {name}; known: {', '.join(sorted(fields))}")
            if value is not None:
                values[name] = _typed(value, fields[name])
    return kind(**values)


def _typed(value, field: dataclasses.Field):
    wanted = field.type if isinstance(field.type, str) else getattr(field.type, "__name__", "")
    if not isinstance(value, str):
        return value
    return {"bool": flag, "int": int, "float": float}.get(wanted, str)(value)


def session_options(spark, prefix: str, kind: type[T]) -> dict:
    """Settings below ``prefix`` of the session, as a source for ``options``."""
    return {f.name: spark.conf.get(f"{prefix}.{f.name}", None) for f in dataclasses.fields(kind)}
