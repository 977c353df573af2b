"""JSON schemas of the replies, for providers that hold a model to one."""

from __future__ import annotations

from typing import Any

TEXT, FLAG, NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "number"}
TEXTS = {"type": "array", "items": TEXT}


def strict(**properties: Any) -> dict:
    """An object with just these properties, all of them required."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def nullable(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


CRITERION = strict(id=TEXT, description=TEXT, weight={"type": "integer"})
_CHECK = strict(passed=FLAG, failures=TEXTS, notes=nullable(TEXT))
#: A judge's marks and a mutation's rules have keys that aren't known before, so these two can't be strict.
SCHEMAS: dict[str, dict] = {
    "quality": _CHECK,
    "audit": _CHECK,
    "judge": {"type": "object", "properties": {"total": NUMBER, "per_criterion": {"type": "object", "additionalProperties": NUMBER}, "failure_modes": TEXTS}, "required": ["total", "per_criterion"]},
    "loop_judge": strict(verdict={"type": "string", "enum": ["accept", "improve"]}, reason=TEXT, suggestion=TEXT, suitability=nullable(TEXT)),
    "reflector": strict(feedback=TEXTS, new_angle=TEXT),
}


def candidate(payload: dict | None = None) -> dict:
    """A challenger's reply around the domain's payload schema; without one the payload may be any object."""
    inner = {"type": "object", "additionalProperties": True} if payload is None else payload
    return strict(payload=inner, reference_output=TEXT, rubric={"type": "array", "items": CRITERION})


def has_open_map(node: Any) -> bool:
    """Does a schema hold an object whose keys aren't fixed? Strict formats don't take these."""
    if isinstance(node, dict):
        more = node.get("additionalProperties", node.get("type") == "object" and "properties" not in node)
        return more is True or isinstance(more, dict) or any(map(has_open_map, node.values()))
    return isinstance(node, list) and any(map(has_open_map, node))


def response_format(library: Any, role: str, model: str, payload: dict | None = None) -> dict:
    """The strict schema of the role's reply if the model takes one, else any JSON object."""
    schema = candidate(payload) if role == "challenger" else SCHEMAS.get(role)
    if schema is not None and not has_open_map(schema):
        try:
            if library.supports_response_schema(model=model):
                return {"type": "json_schema", "json_schema": {"name": f"{role}_reply", "strict": True, "schema": schema}}
        except Exception:  # a model that the library doesn't know
            pass
    return {"type": "json_object"}
