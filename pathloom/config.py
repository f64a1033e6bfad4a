"""Driver-side configuration: YAML in, nested access, dotted overrides."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path
from typing import Any


class Config(Mapping):
    """Read and set values by key or attribute; nested mappings are Configs, too."""

    def __init__(self, values: Mapping[str, Any]):
        object.__setattr__(self, "_values", {k: Config(v) if isinstance(v, Mapping) else v for k, v in values.items()})

    def __getitem__(self, key: str) -> Any:
        return self._values[key]

    def __getattr__(self, key: str) -> Any:
        try:
            return self._values[key]
        except KeyError:
            raise AttributeError(key) from None

    def __setitem__(self, key: str, value: Any) -> None:
        self._values[key] = Config(value) if isinstance(value, Mapping) else value

    def __setattr__(self, key: str, value: Any) -> None:
        self[key] = value

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def to_dict(self) -> dict[str, Any]:
        return {k: v.to_dict() if isinstance(v, Config) else copy.deepcopy(v) for k, v in self._values.items()}

    def __repr__(self) -> str:
        return f"Config({self.to_dict()})"


def load_config(path: str | Path) -> Config:
    """A YAML mapping; a missing file, an empty one and anything else but a mapping are refused."""
    import yaml

    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(p)
    values = yaml.safe_load(p.read_text())
    if values is None:
        raise ValueError(f"{p} is empty")
    if not isinstance(values, Mapping):
        raise ValueError(f"{p} holds a {type(values).__name__}, not a mapping")
    return Config(values)


def merge_configs(base: Config, override: Mapping[str, Any]) -> Config:
    """A new Config; keys of ``override`` may be dotted paths, missing branches are made, ``base`` stays as it is."""
    out = base.to_dict()
    for key, value in (override.to_dict() if isinstance(override, Config) else override).items():
        *branch, last = key.split(".")
        at = out
        for b in branch:
            if not isinstance(at.get(b), dict):
                at[b] = {}
            at = at[b]
        if isinstance(value, Mapping) and isinstance(at.get(last), dict):
            at[last] = merge_configs(Config(at[last]), value).to_dict()
        else:
            at[last] = copy.deepcopy(value)
    return Config(out)


def save_config(config: Config, path: str | Path) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(config.to_dict(), sort_keys=False))
