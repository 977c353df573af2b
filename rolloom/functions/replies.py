"""What models reply, as values. Replies that can't be read fail closed."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^\s*```\w*\s*\n(.*?)\n?\s*```\s*$", re.DOTALL)
_DECODER = json.JSONDecoder()


def salvage(text: str | None) -> dict:
    """The object that a reply is, or the first one in it. ValueError if there is none."""
    body = (text or "").strip()
    if not body:
        raise ValueError("empty reply")
    if m := _FENCE.match(body):
        body = m[1].strip()
    at = body.find("{")
    while at >= 0:
        try:
            found, _ = _DECODER.raw_decode(body, at)
            return found
        except ValueError:
            at = body.find("{", at + 1)
    raise ValueError("no JSON object in the reply")


@F.pandas_udf(StringType())
def _salvaged(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t):
        try:
            return json.dumps(salvage(t), ensure_ascii=False)
        except ValueError:
            return None

    for s in texts:
        yield s.map(one)


def salvaged(text: Column | str) -> Column:
    """Text of the reply's object, null if there is none; Python only sees replies that aren't an object as they stand."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.try_parse_json(c).isNotNull() & F.startswith(F.ltrim(c), F.lit("{"))
    return F.coalesce(F.when(plain, c), _salvaged(F.when(~F.coalesce(plain, F.lit(False)), c)))


def clamp(x: float) -> float:
    return 1.0 if math.isnan(x) else max(0.0, min(1.0, x))


def _number(x: Any) -> float | None:
    try:
        return clamp(float(x))
    except (TypeError, ValueError):
        return None


def _texts(x: Any) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else [str(x)] if x else []


def check(text: str, who: str = "quality") -> dict:
    """{passed, failures, notes} of a quality check or an audit."""
    try:
        d = salvage(text)
    except ValueError as e:
        return {"passed": False, "failures": [f"{who}_parse_error:{e}"], "notes": None}
    notes = d.get("notes")
    return {"passed": bool(d.get("passed")), "failures": _texts(d.get("failures")), "notes": None if notes is None else str(notes)}


def weighted(per: dict[str, float], rubric: list[dict]) -> float:
    weights = {c["id"]: c["weight"] for c in rubric}
    return clamp(sum(per.get(k, 0.0) * w for k, w in weights.items()) / (sum(weights.values()) or 1))


def score(text: str, rubric: list[dict], solver: str, attempt: int, raw: str) -> dict:
    """A judge's reply. Without a total that is a number, the criteria's weighted average."""
    out = {"solver": solver, "attempt": attempt, "raw_response": raw, "total": 0.0, "per_criterion": {}, "failure_modes": [], "correct": None}
    try:
        d = salvage(text)
    except ValueError as e:
        return out | {"failure_modes": [f"judge_parse_error:{e}"]}
    marks = d.get("per_criterion")
    per = {str(k): n for k, v in marks.items() if (n := _number(v)) is not None} if isinstance(marks, dict) else {}
    total = _number(d.get("total"))
    return out | {"total": weighted(per, rubric) if total is None else total, "per_criterion": per, "failure_modes": _texts(d.get("failure_modes"))}


def candidate(text: str, most: int) -> dict:
    """{payload, rubric, reference_output}. ValueError if the reply has no payload object or a reference that is no text."""
    d = salvage(text)
    payload, reference = d.get("payload"), d.get("reference_output")
    if not isinstance(payload, dict):
        raise ValueError("payload is no object")
    if reference is not None and not isinstance(reference, str):
        raise ValueError("reference_output is no text")
    rubric = []
    for i, c in enumerate(d.get("rubric") or []):
        c = c if isinstance(c, dict) else {"description": str(c)}
        try:
            w = int(c.get("weight", 1))
        except (TypeError, ValueError, OverflowError):
            w = 1
        about, n = str(c.get("description") or "").strip(), i + 1
        rubric.append({"weight": max(1, min(most, w)), "id": str(c.get("id") or "") or f"c{n}", "description": about or f"criterion {n}"})
    return {"payload": payload, "rubric": rubric, "reference_output": reference}


def verdict(text: str) -> dict:
    """{accept, reason, suggestion, suitability} of the loop judge; unreadable: not accepted."""
    try:
        d = salvage(text)
    except ValueError as e:
        return {"accept": False, "reason": f"verdict_parse_error:{e}", "suggestion": "", "suitability": None}
    return {"accept": str(d.get("verdict") or "").strip().lower() == "accept", "reason": str(d.get("reason") or ""), "suggestion": str(d.get("suggestion") or ""), "suitability": d.get("suitability")}


def reflection(text: str) -> list[str]:
    """Feedback for the next round."""
    try:
        d = salvage(text)
    except ValueError:
        return ["earlier attempts failed; come from another side"]
    angle = str(d.get("new_angle") or "").strip()
    return _texts(d.get("feedback")) + ([f"NEW_ANGLE: {angle}"] if angle else [])


def leaves(value: Any) -> Iterator[str]:
    """All texts and numbers in a value, as the safety filter sees them."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (bool, int, float)):
        yield str(value)
    elif isinstance(value, (dict, list, tuple)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from leaves(v)


def safety_text(c: dict) -> str:
    return " ".join([*leaves(c["payload"]), *([c["reference_output"]] if c.get("reference_output") else [])])


def short_payload(payload: dict, most: int = 140) -> str:
    """The first text of the payload, else its JSON."""
    return next((v for v in payload.values() if isinstance(v, str)), json.dumps(payload))[:most]
