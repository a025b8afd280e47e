"""Settings of the engine: defaults, a TOML file, explicit values; the later ones win."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Sizes are in estimated tokens; thresholds are cosines."""

    chunk_size: int = 256
    max_chunk_size: int = 4096
    merge_threshold: float = 0.70
    change_threshold: float = 0.85
    search_alpha: float = 0.42
    skip_dirs: tuple[str, ...] = ()

    #: (merge, change) thresholds by modality
    BY_MODALITY = {"text": (0.70, 0.85), "code": (0.85, 0.80), "pdf": (0.75, 0.85)}

    def thresholds(self, modality: str) -> tuple[float, float]:
        return self.BY_MODALITY.get(modality, (self.merge_threshold, self.change_threshold))


def load(path: str | None = None, **given: object) -> EngineConfig:
    """The settings of a TOML file (its top level or its table ``engine``), with ``given`` on top; unknown keys are refused."""
    values: dict[str, object] = {}
    if path and Path(path).exists():
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        values |= raw.get("engine", {k: v for k, v in raw.items() if not isinstance(v, dict)})
    values |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(EngineConfig)}
    if extra := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    if "skip_dirs" in values:
        values["skip_dirs"] = tuple(values["skip_dirs"])  # type: ignore[arg-type]
    return replace(EngineConfig(), **values)
