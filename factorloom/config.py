"""Layered settings: files of JSON or TOML (YAML where a parser is installed), later ones on top, then ``a.b=value``."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterable, Mapping


def merged(base: Mapping, over: Mapping) -> dict:
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def load(path: str) -> dict:
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".json"):
        found = json.loads(data)
    elif path.endswith(".toml"):
        import tomllib

        found = tomllib.loads(data.decode())
    elif path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(data) or {}
    else:
        raise ValueError(f"settings are JSON, TOML or YAML: {path}")
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def scalar(text: str):
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def resolve(paths: Iterable[str] = (), overrides: Iterable[str] = (), defaults: Mapping | None = None) -> dict:
    out = dict(defaults or {})
    for p in paths:
        out = merged(out, load(p))
    for item in overrides:
        name, found, value = item.partition("=")
        if not found or not name.strip():
            raise ValueError(f"not name=value: {item!r}")
        for key in reversed(name.strip().split(".")):
            value = {key: scalar(value) if isinstance(value, str) else value}
        out = merged(out, value)
    return out


def digest(settings: Mapping) -> str:
    """SHA-256 of the settings in one canonical form."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


SECRET = ("token", "password", "secret", "key", "credential")


def redacted(value):
    """Secrets by name replaced, for records of a run."""
    if isinstance(value, Mapping):
        return {k: "***" if any(s in str(k).lower() for s in SECRET) and not isinstance(v, (Mapping, list)) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value
