"""Weights, profiles and rules from files: YAML where its reader is installed, else JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

#: The files of a folder of settings, without their ending.
PARTS = ("ranking", "profiles", "rules", "retrieval")


def read_mapping(path: str | Path) -> dict:
    """A file's mapping; an empty file is an empty one, and what is no mapping raises."""
    text = Path(path).read_text("utf-8-sig")
    if Path(path).suffix == ".json":
        found = json.loads(text) if text.strip() else {}
    elif yaml is None:
        raise ValueError(f"{path}: no YAML reader is installed; use JSON")
    else:
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not a mapping")
    return found


@dataclass(frozen=True)
class Settings:
    """What the files say; a file that is not there says nothing."""

    ranking: dict = field(default_factory=dict)
    profiles: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)

    @property
    def version(self) -> str:
        return str(self.ranking.get("version", ""))

    def weight(self, signal: str) -> float:
        """A signal without a weight weighs 0."""
        return float((self.ranking.get("weights") or {}).get(signal, 0.0))

    def profile(self, kind: str) -> dict:
        """The defaults, each replaced as a whole by what the kind says itself."""
        return {**(self.profiles.get("defaults") or {}), **((self.profiles.get("kinds") or {}).get(kind) or {})}

    def base(self, signals: list[str]) -> Column:
        """The weighted sum of these signals' columns."""
        return sum((F.col(s) * self.weight(s) for s in signals), F.lit(0.0))

    def opportunity_rules(self) -> list[tuple[str, dict[str, float]]]:
        """The rules in the file's order, for ``scoring.opportunities``."""
        return [(r["name"], {c: float(x) for c, x in (r.get("requires") or {}).items()}) for r in self.rules.get("rules") or []]


def load(folder: str | Path) -> Settings:
    """The settings of a folder; of a part in several endings the first of yaml, yml, json counts. A folder without any raises."""
    found = {}
    for part in PARTS:
        path = next((p for p in (Path(folder, f"{part}.{end}") for end in ("yaml", "yml", "json")) if p.is_file()), None)
        if path:
            found[part] = read_mapping(path)
    if not found:
        raise ValueError(f"no settings in {folder}")
    return Settings(**found)
