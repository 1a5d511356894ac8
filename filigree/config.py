"""Configuration: dataclasses, YAML files, and overrides by dotted names."""

from __future__ import annotations

import copy
import dataclasses
import hashlib
import json
import types
import typing
from dataclasses import dataclass, field

import yaml


@dataclass
class DatasetConfig:
    name: str = "copurchase"
    path: str | None = None
    relation: str | None = None
    task: str = "anomaly"
    injection: str | None = None
    n_groups: int = 2
    group_size: int = 6
    anomaly_class: int = 0
    n_anomaly_graphs: int = 20


@dataclass
class ModelConfig:
    embedder: str = "structural"
    tau: float = 1e-9
    margin: float = 0.1
    checkpoint: str | None = None


@dataclass
class SamplingConfig:
    sampler: str = "radial"
    n_neighborhoods: int = 10_000
    min_size: int = 1
    max_size: int = 30
    radius: int = 1
    subsample_size: int = 0


@dataclass
class SearchSection:
    strategy: str = "sampled"
    scoring_function: str = "freq"
    n_beams: int = 1
    min_strength: float = 0.0
    max_freq: float = 15.0
    calibrate: bool = False
    alpha: float = 0.33
    max_unchanged: int = 5
    min_steps: int = 1
    max_steps: int = 7
    max_cands: int | None = None
    sample_random_cands: float | None = None
    add_verified_neighs: bool = False
    min_neigh_repeat: int = 2
    sample_size: int = 500
    min_subgraph_size: int = 1


@dataclass
class OutlierConfig:
    methods: list[str] = field(default_factory=lambda: ["model_based"])
    combine: str = "union"
    max_freq: float = 60.0
    contamination: float = 0.2


@dataclass
class TrainingConfig:
    n_pairs: int = 2000
    rounds: int = 200
    lr: float = 0.05
    eval_interval: int = 20
    hard_neg_ratio: float = 0.5


@dataclass
class Config:
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    search: SearchSection = field(default_factory=SearchSection)
    outlier: OutlierConfig = field(default_factory=OutlierConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    callbacks: list[str] = field(default_factory=list)
    output: str | None = None
    seed: int = 42

    def key(self) -> str:
        """A hash of all settings, under which what depends on them can be kept."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def coerce(value: object, kind: object) -> object:
    """A value from a command line as the type of its field; ``none`` and ``null`` are None where that is allowed. Lists stay as they are."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        if value is None or (isinstance(value, str) and value.lower() in ("none", "null")):
            return None
        return coerce(value, next(k for k in typing.get_args(kind) if k is not type(None)))
    if isinstance(value, str) and kind is bool:
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is no truth value")
        return value.lower() in ("true", "1", "yes")
    return kind(value) if kind in (int, float, str) and value is not None else value


def _fill(made: object, values: dict) -> None:
    kinds = typing.get_type_hints(type(made))
    for k, v in (values or {}).items():
        if k not in kinds:
            raise KeyError(f"{type(made).__name__} has no {k!r}")
        now = getattr(made, k)
        if dataclasses.is_dataclass(now):
            _fill(now, v)
        else:
            setattr(made, k, coerce(v, kinds[k]))


def load_config(path: str) -> Config:
    """Of a YAML file; an empty one gives the defaults."""
    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    out = Config()
    _fill(out, values)
    return out


def with_overrides(config: Config, overrides: dict[str, object]) -> Config:
    """A copy with ``{"search.max_steps": "5"}`` and the like."""
    out = copy.deepcopy(config)
    for dotted, value in overrides.items():
        *way, last = dotted.split(".")
        at = out
        for w in way:
            at = getattr(at, w)
        kinds = typing.get_type_hints(type(at))
        if last not in kinds:
            raise KeyError(f"no setting {dotted!r}")
        setattr(at, last, coerce(value, kinds[last]))
    return out
