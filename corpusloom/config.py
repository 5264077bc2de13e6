"""Settings: defaults, then a global YAML file, a project's YAML file, the environment, and arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from copy import deepcopy
from typing import Any

DEFAULTS: dict[str, Any] = {
    "workspace": ".",
    "chunking": {"strategy": "ast", "size_chars": 500, "overlap_chars": 50, "size_lines": 50, "overlap_lines": 5},
    "embedding": {"batch_size": 100, "dim": 64},
    "sparse": {"enabled": True, "vocabulary": 50_000},
    "git": {"enabled": True, "only_tracked": False},
    "web": {"skip_existing": True, "max_pages": 50, "max_depth": 3, "cache_seconds": 600},
    "search_backend": "duckduckgo",
}


def merged(strong: Mapping[str, Any], weak: Mapping[str, Any]) -> dict[str, Any]:
    """strong, with what it lacks filled in from weak, at every depth."""
    out = deepcopy(dict(weak))
    for key, value in strong.items():
        out[key] = merged(value, out[key]) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


def from_environment(prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """PREFIX_A__B=x as {"a": {"b": x}}; values are read as YAML scalars."""
    import yaml

    out: dict[str, Any] = {}
    for key, value in sorted((environment if environment is not None else os.environ).items()):
        if key.startswith(prefix):
            *path, last = key[len(prefix) :].lower().split("__")
            at = out
            for part in path:
                at = at.setdefault(part, {})
            at[last] = yaml.safe_load(value)
    return out


def from_file(path: str | None) -> dict[str, Any]:
    """A YAML file's settings; none for a missing one."""
    if not path or not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load(*, project_file: str | None = None, global_file: str | None = None, prefix: str = "CORPUSLOOM_", environment: Mapping[str, str] | None = None, **given: Any) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for source in (given, from_environment(prefix, environment), from_file(project_file), from_file(global_file), DEFAULTS):
        out = merged(out, source)
    return out


def collection_name(root: str | None) -> str:
    """A project's collection is named like its folder."""
    return os.path.basename(os.path.abspath(root)) if root else "global"
