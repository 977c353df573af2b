"""Settings of a run, from YAML with ${NAME} and ${NAME:default}. Reading is strict; snapshots may have unknown keys."""

from __future__ import annotations

import os
import re
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml

from rolloom.operators.scoring import Limits


def _empty():
    return field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    provider_model: str = "mock/scripted"
    max_tokens: int = 8192
    extra: dict = _empty()
    top_p: float = 1.0
    temperature: float | None = None


@dataclass(frozen=True)
class Acceptance(Limits):
    mode: str | None = None  # rubric, verifiable or judge; None: the domain's

    def __post_init__(self):
        if self.mode not in (None, "rubric", "verifiable", "judge"):
            raise ValueError(f"acceptance.mode can't be {self.mode!r}")


@dataclass(frozen=True)
class Audit:
    grounding_chars: int = 4000
    include_evidence: bool = True
    enabled: bool = False


@dataclass(frozen=True)
class Loop:
    short_circuit_strong: bool = True
    max_rounds: int = 20
    strong_samples: int = 4
    weak_samples: int = 4


@dataclass(frozen=True)
class Domain:
    name: str | None = None
    params: dict = _empty()
    path: str | None = None

    def __post_init__(self):
        if not (self.name or self.path):
            raise ValueError("domain needs a name or a path")


@dataclass(frozen=True)
class Safety:
    enabled: bool = False
    filter: str | None = None


@dataclass(frozen=True)
class Dispatch:
    mode: str = "local"
    concurrency: int = 4
    batch_size: int = 10_000
    batch_completion_window: str = "24h"
    batch_provider: str = "openai"
    items_per_advance: int = 50
    max_request_failures: int = 3
    poll_interval_s: float = 5.0
    shutdown_grace_s: float = 5.0

    def __post_init__(self):
        if self.mode not in ("local", "batch"):
            raise ValueError(f"dispatcher.mode can't be {self.mode!r}")


@dataclass(frozen=True)
class Evolution:
    boltzmann_temp: float = 0.1
    enabled: bool = False
    inner_max_rounds: int = 3
    max_iterations: int = 20
    inner_max_examples_per_run: int = 8
    max_val_reevals: int = 5
    output_subdir: str = "metaopt"
    train_size: int = 6
    val_seed: int = 1
    val_size: int = 4
    seed_harness_path: str | None = None
    mutator: Model | None = None


#: Which setting names the model of a role; all others are the judge's.
MODELS = dict(challenger="challenger", weak="weak_solver", strong="strong_solver", reflector="orchestrator", audit="auditor")


@dataclass(frozen=True)
class RunConfig:
    domain: Domain
    acceptance: Acceptance = field(default_factory=Acceptance)
    audit: Audit = field(default_factory=Audit)
    auditor: Model | None = None
    budget_usd: float | None = None
    challenger: Model = field(default_factory=Model)
    dispatcher: Dispatch = field(default_factory=Dispatch)
    judge: Model = field(default_factory=Model)
    loop: Loop = field(default_factory=Loop)
    max_examples: int = 10
    max_retries: int = 3
    metaopt: Evolution = field(default_factory=Evolution)
    orchestrator: Model = field(default_factory=Model)
    output_dir: str = "outputs"
    prices: dict = _empty()  # model or glob: [USD per million prompt tokens, per million completion tokens]
    rate_limits: dict = _empty()  # model or glob: requests a minute
    request_timeout_s: int = 60
    resume: bool = True
    run_id: str | None = None
    safety: Safety = field(default_factory=Safety)
    strong_solver: Model = field(default_factory=Model)
    weak_solver: Model = field(default_factory=Model)

    def __post_init__(self):
        """In batch mode all requests go to one provider, the auditor's too."""
        d = self.dispatcher
        if d.mode == "batch" and self.audit.enabled and self.auditor:
            own = self.auditor.provider_model.partition("/")[0]
            if own != d.batch_provider:
                raise ValueError(f"the auditor's provider {own!r} isn't the batch provider {d.batch_provider!r}")

    def model(self, role: str) -> Model:
        """The model that plays a role."""
        return getattr(self, MODELS.get(role, "judge")) or self.judge


_VAR = re.compile(r"[$][{](?P<name>[A-Za-z_]\w*)(?::(?P<other>[^}]*))?[}]", re.ASCII)


def interpolate(value: Any) -> Any:
    """Environment variables into all strings; one that is unset and has no default stays as it is written."""
    if isinstance(value, str):
        return _VAR.sub(lambda m: os.environ.get(m["name"], m[0] if m["other"] is None else m["other"]), value)
    if isinstance(value, dict):
        return {k: interpolate(v) for k, v in value.items()}
    return [interpolate(v) for v in value] if isinstance(value, list) else value


def build(cls: type, data: dict, strict: bool = True, at: str = ""):
    """A settings object from a mapping; unknown keys are an error if strict, else dropped."""
    if not isinstance(data, dict):
        raise ValueError(f"{at or 'settings'} must be a mapping")
    hints = get_type_hints(cls)
    known = {f.name: f for f in fields(cls)}
    if strict and (extra := set(data) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(at + str(x) for x in sorted(map(str, extra)))}")
    out = {}
    for name, f in known.items():
        if name not in data:
            if f.default is MISSING and f.default_factory is MISSING:
                raise ValueError(f"{at}{name} is missing")
            continue
        value = data[name]
        inner = next((t for t in (hints[name], *getattr(hints[name], "__args__", ())) if is_dataclass(t)), None)
        out[name] = build(inner, value, strict, f"{at}{name}.") if inner and value is not None else value
    return cls(**out)


def load(path: str | Path) -> RunConfig:
    return build(RunConfig, interpolate(yaml.safe_load(Path(path).read_text()) or {}))


def load_snapshot(path: str | Path) -> RunConfig:
    return build(RunConfig, yaml.safe_load(Path(path).read_text()) or {}, strict=False)


def write_snapshot(config: RunConfig, path: str | Path) -> None:
    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False))
