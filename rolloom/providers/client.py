"""One call: rate limit, retries, cost. It runs on executors, inside mapInPandas."""

from __future__ import annotations

import fnmatch
import json
import random
import threading
import time
from dataclasses import dataclass, field
from typing import Any

from rolloom.domains.base import load_object
from rolloom.providers import formats, mock


@dataclass
class Bucket:
    """Requests a minute, with a burst of a quarter of them unless it is given. Clock and sleep can be replaced."""

    per_minute: float
    burst: float | None = None
    clock: Any = time.monotonic
    sleep: Any = time.sleep

    def __post_init__(self):
        self.rate = self.per_minute / 60
        self.burst = self.burst or max(1.0, self.per_minute // 4)
        self.tokens, self.at, self.lock = float(self.burst), self.clock(), threading.Lock()

    def take(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
                if self.tokens >= 1:
                    self.tokens -= 1
                    return
                wait = (1 - self.tokens) / self.rate
            self.sleep(wait)


def limit_for(limits: dict[str, float], model: str) -> float | None:
    """By the exact name, else the first pattern that matches."""
    return limits.get(model, next((v for k, v in limits.items() if fnmatch.fnmatchcase(model, k)), None))


#: Errors by the names that libraries give them: asking again won't help.
FINAL = ("BadRequest", "Authentication", "PermissionDenied", "NotFound", "UnprocessableEntity", "ContextWindow", "ContentPolicy", "InvalidRequest", "UnsupportedParams")


def retryable(e: Exception) -> bool:
    status = getattr(e, "status_code", None)
    if isinstance(e, (ValueError, TypeError, KeyError, ImportError)) or any(n in type(e).__name__ for n in FINAL):
        return False
    return status is None or status in (408, 409, 429) or status >= 500


@dataclass
class Client:
    """Settings and state of the calls of one process; share: by how many processes a rate is divided."""

    limits: dict[str, float] = field(default_factory=dict)
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    timeout_s: float = 60
    max_retries: int = 3
    share: int = 1
    extra: dict[str, dict] = field(default_factory=dict)
    payloads: dict | None = None  # the JSON schema of the domain's payload
    handlers: str | None = None  # module:function or file.py:function for all mock models
    sleep: Any = time.sleep

    def __post_init__(self):
        self.buckets: dict[str, Bucket] = {}

    def complete(self, role: str, model: str, messages: list[dict], json_mode: bool = False, temperature: float | None = None, max_tokens: int | None = None):
        """{model, text, prompt_tokens, completion_tokens, cost_usd, duration_ms}."""
        begun = time.monotonic()
        known = None
        if model.startswith("mock/"):
            self._wait(model)
            h = load_object(self.handlers) if self.handlers else mock.handler(model.split("/", 1)[1])
            text = h(role, messages)
            used = (sum(len(m["content"].split()) for m in messages), len(text.split()))
            got = {"model": model, "text": text}
        else:
            got, used, known = self._live(role, model, messages, json_mode, temperature, max_tokens)
        price = limit_for(self.prices, model)
        cost = known if price is None else (used[0] * price[0] + used[1] * price[1]) / 1e6
        return got | {"prompt_tokens": used[0], "completion_tokens": used[1], "cost_usd": cost, "duration_ms": int((time.monotonic() - begun) * 1000)}

    def _wait(self, model: str) -> None:
        """Until the model's rate lets a call through."""
        rate = limit_for(self.limits, model)
        if rate:
            self.buckets.setdefault(model, Bucket(rate / self.share, sleep=self.sleep)).take()

    def _live(self, role, model, messages, json_mode, temperature, max_tokens):
        """(model and text, tokens used, what the library says it cost, or None)."""
        args = self.extra.get(model, {}) | {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None}
        for left in range(self.max_retries, -1, -1):
            self._wait(model)
            try:
                import litellm

                if json_mode:
                    args["response_format"] = formats.response_format(litellm, role, model, self.payloads)
                r = litellm.completion(model=model, messages=messages, timeout=self.timeout_s, **args)
                u = r.usage
                try:
                    cost = float(litellm.completion_cost(completion_response=r, model=model))
                except Exception:  # a model without a known price
                    cost = None
                return {"model": r.model or model, "text": r.choices[0].message.content or ""}, (u.prompt_tokens, u.completion_tokens), cost
            except Exception as e:
                if not left or not retryable(e):
                    raise
                self.sleep(min(20.0, random.uniform(1, 2 ** (self.max_retries - left + 1))))
        raise AssertionError


def caller(make: dict):
    """For mapInPandas over requests: a row for each, with the reply or the error, never raising."""

    def run(batches):
        import pandas as pd

        client = Client(**make)
        for b in batches:
            rows = []
            for r in b.itertuples():
                row = {"request_id": r.request_id, "model": None, "text": None, "prompt_tokens": None, "completion_tokens": None, "cost_usd": None, "duration_ms": None, "error": None}
                try:
                    own = json.loads(r.payload)
                    row |= client.complete(own["role"], own["model_key"], own["messages"], own["json_mode"], own.get("temperature"), own.get("max_tokens"))
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                rows.append(row)
            yield pd.DataFrame(rows, columns=list(CALL_COLUMNS)).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64", "duration_ms": "Int64", "cost_usd": "Float64"})

    return run


CALL_COLUMNS = {"request_id": "string", "model": "string", "text": "string", "prompt_tokens": "long", "completion_tokens": "long", "cost_usd": "double", "duration_ms": "long", "error": "string"}
CALL_SCHEMA = ", ".join(f"{k} {v}" for k, v in CALL_COLUMNS.items())
