"""The offline provider: mock/<scenario> answers from the role and the messages alone."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from hashlib import sha256

Handler = Callable[[str | None, list[dict]], str]

#: Words of our prompts by which a request without a role is recognised, in this order.
TAGS = (("challenger", "TASK:propose"), ("quality", "TASK:check"), ("judge", "TASK:score"), ("loop_judge", "TASK:decide"), ("reflector", "TASK:reflect"), ("weak", "TASK:solve"))
_ROUND = re.compile(r"ROUND[\s:=]+([0-9]+)")
_handlers: dict[str, Handler] = {}


def register(scenario: str) -> Callable[[Handler], Handler]:
    def add(f: Handler) -> Handler:
        _handlers[scenario] = f
        return f

    return add


def handler(scenario: str) -> Handler:
    """The scenario's handler; the default one's if it is unknown."""
    return _handlers.get(scenario, _handlers["default"])


def role_of(role: str | None, messages: list[dict]) -> str:
    text = joined(messages)
    return role or next((r for r, tag in TAGS if tag in text), "challenger")


def joined(messages: list[dict]) -> str:
    return " ".join(m["content"] for m in messages)


def round_of(messages: list[dict]) -> int:
    m = _ROUND.search(joined(messages))
    return int(m[1]) if m else 1


def say(**reply) -> str:
    return json.dumps(reply)


def _bit(text: str, n: int) -> int:
    return int(sha256(text.encode()).hexdigest(), 16) % n


def proposal(messages: list[dict], **payload) -> str:
    own = payload or {"question": f"Which detail matters, {_bit(joined(messages), 10**6)}?", "context": "As the source has it.", "reasoning_skills": ["reading"]}
    return say(payload=own, rubric=[dict(weight=w, id=i, description=d) for i, d, w in (("c1", "names it", 5), ("c2", "says why", 3))], reference_output="the detail of the source")


@register("default")
def default(role: str | None, messages: list[dict]) -> str:
    """Accepts from the second round on; in the first the strong solver isn't better."""
    role, text = role_of(role, messages), joined(messages)
    if role == "challenger":
        return proposal(messages)
    if role in ("quality", "audit"):
        return say(notes="", passed=True, failures=[])
    if role in ("weak", "strong"):
        return f"{role} answer {_bit(text, 1000)}"
    if role == "judge":
        total = 0.85 if "strong answer" in text else 0.4
        return say(total=total, failure_modes=[], per_criterion=dict.fromkeys(("c1", "c2"), total))
    if role == "loop_judge":
        return say(verdict="accept", reason="a clear gap", suggestion="", suitability="high")
    if role == "reflector":
        return say(new_angle="the exception", feedback=["name the detail"])
    return say(challenger_rules_add=[f"Ask about rare detail {_bit(text, 100)}."], rationale="one more rule")


register("scripted")(default)


@register("reject")
def reject(role: str | None, messages: list[dict]) -> str:
    """Weak answers are as good as strong ones."""
    return say(total=0.9, failure_modes=["same"]) if role_of(role, messages) == "judge" else default(role, messages)


@register("second_round")
def second_round(role: str | None, messages: list[dict]) -> str:
    """The first proposal of an item fails its check."""
    if role_of(role, messages) == "challenger":
        return "no JSON here" if round_of(messages) == 1 else proposal(messages)
    return default(role, messages)


@register("failing")
def failing(role: str | None, messages: list[dict]) -> str:
    raise RuntimeError("the provider is down")


@register("metaopt")
def metaopt(role: str | None, messages: list[dict]) -> str:
    """Quality passes only with a rule on rare details."""
    if role_of(role, messages) == "quality":
        return say(passed="rare" in joined(messages) or not _bit(joined(messages), 3), failures=["generic: any reader knows"])
    if role == "meta_mutator":
        return say(quality_rules_add=["Let rare details pass."], rationale="generic questions")
    return default(role, messages)


@register("math")
def math(role: str | None, messages: list[dict]) -> str:
    """For checked answers: the strong solver is right, the weak one in its first attempt of some problems."""
    role, text = role_of(role, messages), joined(messages)
    if role == "challenger":
        n = _bit(text, 90) + 10
        out = json.loads(proposal(messages, problem=f"What is half of {2 * n} apples?", topic="halves", difficulty="school"))
        return json.dumps(out | {"reference_output": str(n)})
    if role in ("weak", "strong"):
        m = re.search(r"half of (\d+)", text)
        n = int(m[1]) // 2 if m else 0
        return f"ANSWER: {n if role == 'strong' else n + 1}"
    return default(role, messages)
