from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rolloom.functions import replies as R

RUBRIC = [{"id": "c1", "description": "x", "weight": 5}, {"id": "c2", "description": "y", "weight": 3}]


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', {"a": 1}), ('```json\n{"a": 2}\n```', {"a": 2}), ('Sure! {"a": {"b": "}"}} bye', {"a": {"b": "}"}}), ('{broken {"a": 3}', {"a": 3}), ('[{"a": 4}]', {"a": 4})])
def test_salvage(spark, text, want):
    assert R.salvage(text) == want
    import json

    assert json.loads(spark.createDataFrame([(text,)], "t string").select(R.salvaged("t").alias("x")).first().x) == want


@pytest.mark.parametrize("text", ["", None, "no", "[1, 2]", "3", '"s"', "{"])
def test_salvage_fails(spark, text):
    with pytest.raises(ValueError, match="reply"):
        R.salvage(text)
    assert spark.createDataFrame([(text,)], "t string").select(R.salvaged(F.col("t")).alias("x")).first().x is None


def test_checks_fail_closed():
    assert not R.check("no")["passed"] and R.check("no", "audit")["failures"][0].startswith("audit_parse_error")
    assert R.check('{"passed": true, "failures": null, "notes": 5}') == {"passed": True, "failures": [], "notes": "5"}
    assert R.check('{"passed": "false"}')["passed"] and not R.check("{}")["passed"]


def test_scores():
    s = R.score('{"per_criterion": {"c1": 1.5, "c2": "x"}}', RUBRIC, "weak", 0, "raw")
    assert s["per_criterion"] == {"c1": 1.0} and s["total"] == 0.625
    assert R.score('{"total": 9}', RUBRIC, "weak", 0, "")["total"] == 1.0
    assert R.score('{"total": "high", "per_criterion": []}', RUBRIC, "weak", 0, "")["total"] == 0.0
    assert R.score("no", RUBRIC, "weak", 0, "")["failure_modes"][0].startswith("judge_parse_error")


def test_candidates():
    c = R.candidate('{"payload": {"q": 1}, "reference_output": "r", "rubric": ["bare", {"id": "k", "description": " ", "weight": 99}, {"weight": "w"}]}', 7)
    assert [(x["id"], x["description"], x["weight"]) for x in c["rubric"]] == [("c1", "bare", 1), ("k", "criterion 2", 7), ("c3", "criterion 3", 1)]
    for bad in ('{"payload": [1]}', '{"payload": {}, "reference_output": 42}', "{}"):
        with pytest.raises(ValueError):
            R.candidate(bad, 7)


def test_verdicts_and_feedback():
    assert R.verdict('{"verdict": " ACCEPT "}')["accept"] and not R.verdict("?")["accept"]
    assert R.reflection('{"feedback": ["a"], "new_angle": "b"}') == ["a", "NEW_ANGLE: b"] and len(R.reflection("?")) == 1


def test_leaves():
    assert R.safety_text({"payload": {"a": ["x", 1, {"b": True}], "c": None}, "reference_output": "r"}) == "x 1 True r"
    assert R.short_payload({"n": 1, "s": "t" * 200}) == "t" * 140 and R.short_payload({"n": 1}) == '{"n": 1}'
