"""The domain interface and its registry."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from rolloom.functions.safety import load_object

Messages = list[dict[str, str]]

_known: dict[str, type[Domain]] = {}


class Domain(ABC):
    """Six methods are needed. Prompts run on executors, so a domain must pickle."""

    name = ""
    mode = "rubric"

    def __init__(self, **params):
        self.params = params

    @abstractmethod
    def grounding(self, spark: SparkSession) -> DataFrame:
        """(source_id, body, metadata) of all items."""

    @abstractmethod
    def generation_prompt(self, item: dict, feedback: list[str], round_n: int, prior: list[dict]) -> Messages: ...

    @abstractmethod
    def validate(self, candidate: dict) -> list[str]:
        """What is wrong with the shape of a candidate."""

    @abstractmethod
    def solver_prompt(self, candidate: dict) -> Messages: ...

    @abstractmethod
    def quality_prompt(self, candidate: dict) -> Messages: ...

    @abstractmethod
    def judge_prompt(self, candidate: dict, answer: str) -> Messages: ...

    def verify(self, candidate: dict, answer: str) -> bool | None:
        """Is the answer right? None: can't tell."""
        raise NotImplementedError

    @property
    def verifiable(self) -> bool:
        return type(self).verify is not Domain.verify

    def leakage_rules(self) -> list[str]:
        return []

    def payload_fields(self) -> dict[str, str] | None:
        """Names and JSON types of the payload, if they are fixed."""
        return None

    def audit_prompt(self, candidate: dict, source: str, evidence: dict | None) -> Messages:
        ask = {"candidate": candidate, "source": source, "leakage_rules": self.leakage_rules()} | ({"scores": evidence} if evidence else {})
        return chat("You are the last check before an example is kept. Does the source support it, is it free of leaks, is the reference right? Reply with JSON: passed, failures, notes.", json.dumps(ask, ensure_ascii=False))

    def record(self, candidate: dict) -> dict:
        """What is kept of an accepted candidate."""
        return {"input": candidate["payload"], "reference_output": candidate["reference_output"], "rubric": candidate["rubric"], "domain": candidate["domain"], "source_id": candidate["source_id"], "metadata": candidate.get("metadata") or {}}


def chat(system: str, user: str) -> Messages:
    return [dict(role=r, content=c) for r, c in (("system", system), ("user", user))]


def rubric(*criteria: tuple[str, str, int]) -> list[dict]:
    return [{"id": i, "description": d, "weight": w} for i, d, w in criteria]


def lines(items: list, key: str | None = None, most: int | None = None) -> str:
    texts = [str(x.get(key, "") if key and isinstance(x, dict) else x)[:most] for x in items]
    return "\n".join(f"- {t}" for t in texts) or "(none)"


def register(cls: type[Domain]) -> type[Domain]:
    _known[cls.name] = cls
    return cls


def names() -> list[str]:
    return sorted(_known)


def build(name: str | None = None, path: str | None = None, params: dict | None = None) -> Domain:
    """A registered domain, or the class that 'module:Class' or 'file.py:Class' names."""
    if path:
        cls = load_object(path)
        if not (isinstance(cls, type) and issubclass(cls, Domain)):
            raise TypeError(f"{path} is no Domain")
    elif name in _known:
        cls = _known[name]
    else:
        raise KeyError(f"no domain {name!r}; there are {', '.join(names())}")
    return cls(**(params or {}))
