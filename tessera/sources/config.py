"""Protocol files: JSON sections with known keys, read through Spark so that any store works."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Emulation:
    folds: int = 5
    epsilon: float = 0.05
    n_min: int = 40
    ridge: float = 1.0


@dataclass(frozen=True)
class Gate:
    alpha: float = 0.1
    margin: float = 0.0
    depth: int = 3


@dataclass(frozen=True)
class Protocol:
    name: str = "main"
    emulation: Emulation = field(default_factory=Emulation)
    gate: Gate = field(default_factory=Gate)


def parse(payload: dict) -> Protocol:
    """A protocol from nested values. Unknown keys of a known section are errors; unknown sections are ignored."""
    sections = {}
    for name, kind in (("emulation", Emulation), ("gate", Gate)):
        given = payload.get(name, {})
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"section {name} has unknown keys: {', '.join(sorted(unknown))}")
        sections[name] = kind(**given)
    rule = sections["emulation"]
    if not 0 < rule.epsilon < 0.5 or rule.folds < 2 or rule.n_min < 1:
        raise ValueError("emulation needs 0 < epsilon < 1/2, two folds or more and n_min of one or more")
    return Protocol(name=payload.get("name", "main"), **sections)


def load(spark: SparkSession, path: str) -> Protocol:
    return parse(json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def merge(payload: dict, overrides: dict) -> dict:
    """payload with the overrides' values in place of its own, section by section; neither is changed."""
    out = dict(payload)
    for key, value in overrides.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
