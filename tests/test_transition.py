from __future__ import annotations

import copy
import json

import pytest

from rolloom.domains.base import Domain as Base
from rolloom.domains.base import chat
from rolloom.operators.evolve import Harness
from rolloom.operators.transition import Machine, new_item
from rolloom.providers.mock import proposal
from rolloom.sources.config import Acceptance, Audit, Domain, Loop, RunConfig, Safety

GROUND = {"source_id": "s", "body": "the source", "metadata": {}}


class Plain(Base):
    name = "plain"

    def grounding(self, spark):
        raise NotImplementedError

    def generation_prompt(self, item, feedback, round_n, prior):
        return chat("TASK:propose", json.dumps([item["body"], feedback, round_n, prior]))

    def validate(self, candidate):
        return ["empty"] if candidate["payload"].get("empty") else []

    def solver_prompt(self, candidate):
        return chat("TASK:solve", "q")

    def quality_prompt(self, candidate):
        return chat("TASK:check", "q")

    def judge_prompt(self, candidate, answer):
        return chat("TASK:score", answer)


class Checked(Plain):
    name = "checked"
    mode = "verifiable"

    def verify(self, candidate, answer):
        if "boom" in answer:
            raise RuntimeError("boom")
        return None if "skip" in answer else "right" in answer


def machine(domain=None, watch=None, **more):
    more.setdefault("loop", Loop(max_rounds=3, weak_samples=2, strong_samples=2, short_circuit_strong=False))
    return Machine(RunConfig(domain=Domain("qa_from_documents"), **more), domain or Plain(), Harness(), watch)


class Drive:
    """Steps one item, answering what is asked."""

    def __init__(self, m):
        self.m, self.item, self.asked, self.rounds, self.scores = m, new_item("r", "s", "plain"), [], [], []

    def step(self, *replies):
        before = copy.deepcopy(self.item)
        out = self.m.advance(self.item, list(replies), GROUND)
        assert self.item == before, "advance is pure"
        self.item = out.item
        self.rounds += out.rounds
        self.scores += out.scores
        self.asked = out.requests
        self.accepted = out.accepted
        return self

    @property
    def roles(self):
        return [r["role"] for r in self.asked]

    def answer(self, *texts, **by_role):
        asked = self.asked
        said = list(texts)
        replies = []
        for r in asked:
            text = by_role[r["role"]] if r["role"] in by_role else said.pop(0)
            replies.append({**{k: r[k] for k in ("request_id", "role", "round_n", "attempt", "parent_response_id", "solver_role", "solver_text")}, "text": text})
        return self.step(*replies)

    def to_scores(self):
        self.step().answer(proposal([{"content": "x"}])).answer('{"passed": true}')
        return self

    def judged(self, weak, strong):
        self.answer(weak="a weak one", strong="a strong one")
        texts = [json.dumps({"total": weak if r["solver_role"] == "weak" else strong}) for r in self.asked]
        return self.answer(*texts)


def test_accepts():
    d = Drive(machine())
    assert d.step().roles == ["challenger"] and d.item["state"] == "NEED_CANDIDATE"
    assert d.answer(proposal([{"content": "x"}])).roles == ["quality"]
    assert sorted(d.answer('{"passed": true}').roles) == ["strong", "strong", "weak", "weak"]
    d.judged(0.3, 0.8)
    assert d.item["state"] == "ACCEPTED" and d.rounds[-1]["accepted"] and len(d.scores) == 4 and d.accepted["gap"] == pytest.approx(0.5)
    assert d.step().item["state"] == "ACCEPTED" and d.asked == []


def test_waits_and_ignores_other_rounds():
    d = Drive(machine()).step()
    asked = d.asked
    assert d.step().item["state"] == "NEED_CANDIDATE" and d.asked == []
    late = {"request_id": "x", "role": "challenger", "round_n": 7, "attempt": 0, "text": proposal([{"content": "x"}])}
    assert d.step(late).item["state"] == "NEED_CANDIDATE"
    d.asked = asked
    d.answer(proposal([{"content": "x"}])).answer('{"passed": true}')
    half = d.asked[:2]
    d.asked = half
    d.answer(weak="a", strong="b")
    assert d.item["state"] == "NEED_SCORES" and d.roles == ["judge", "judge"]


def test_rejects_after_the_last_round():
    d = Drive(machine())
    for n in (1, 2, 3):
        d.to_scores() if n == 1 else d.answer(proposal([{"content": "x"}])).answer('{"passed": true}')
        d.judged(0.9, 0.9)
        if n < 3:
            assert d.item["state"] == "NEED_REFLECTION" and d.roles == ["reflector"]
            d.answer('{"feedback": ["f"], "new_angle": "n"}')
            assert d.item["round"] == n + 1 and d.item["feedback"] == ["f", "NEW_ANGLE: n"] and d.roles == ["challenger"] and d.item["scores"] == []
    assert d.item["state"] == "REJECTED" and d.item["reasons"] and len(d.rounds) == 3


@pytest.mark.parametrize(("reply", "why"), [("no JSON", "challenger_parse_error"), ('{"payload": {"empty": 1}, "rubric": []}', "empty")])
def test_bad_candidates(reply, why):
    d = Drive(machine()).step().answer(reply)
    assert d.item["state"] == "NEED_REFLECTION" and d.rounds[-1]["quality"]["failures"][0].startswith(why) and d.rounds[-1]["evaluation"] is None


def test_quality_fails():
    d = Drive(machine(loop=Loop(max_rounds=1))).step().answer(proposal([{"content": "x"}])).answer('{"passed": false, "failures": ["leak"]}')
    assert d.item["state"] == "REJECTED" and d.item["reasons"] == ["leak"]


def test_safety():
    on = {"safety": Safety(enabled=True)}

    def broken(_):
        raise RuntimeError("x")

    for f, why in ((lambda t: (False, ["pii:email"]), "safety:pii:email"), (broken, "safety:filter_error:x")):
        d = Drive(machine(watch=f, **on)).step().answer(proposal([{"content": "x"}]))
        assert d.rounds[-1]["quality"]["failures"] == [why]
    assert Drive(machine(watch=lambda t: (True, []), **on)).step().answer(proposal([{"content": "x"}])).roles == ["quality"]


def test_short_circuit():
    loop = Loop(max_rounds=2, weak_samples=2, strong_samples=2)
    d = Drive(machine(loop=loop)).to_scores()
    assert set(d.roles) == {"weak"}
    d.judged(0.9, None)
    assert d.item["state"] == "NEED_REFLECTION" and d.rounds[-1]["evaluation"]["reasons"][0].startswith("short_circuit") and d.rounds[-1]["evaluation"]["gap"] < 0
    d = Drive(machine(loop=loop)).to_scores().judged(0.3, None)
    assert d.roles == ["strong", "strong"] and d.item["state"] == "NEED_SCORES"
    d.judged(None, 0.8)
    assert d.item["state"] == "ACCEPTED"


def test_verifiable():
    loop = Loop(max_rounds=2, weak_samples=4, strong_samples=4, short_circuit_strong=False)
    d = Drive(machine(Checked(), loop=loop)).to_scores().answer(weak="wrong", strong="right")
    assert d.item["state"] == "ACCEPTED" and all(s["correct"] is (s["solver"] == "strong") for s in d.scores)
    d = Drive(machine(Checked(), loop=loop)).to_scores().answer(weak="skip", strong="boom")
    assert {s["failure_modes"][0].split(":")[0] for s in d.scores} == {"unverifiable", "verify_error"} and all(s["correct"] is None for s in d.scores)
    assert d.item["state"] == "NEED_REFLECTION"


def test_judge_mode():
    m = machine(acceptance=Acceptance(mode="judge"))
    d = Drive(m).to_scores().judged(0.9, 0.9)
    assert d.roles == ["loop_judge"] and d.item["state"] == "NEED_DECISION"
    d.answer('{"verdict": "improve", "reason": "dull", "suggestion": "sharper"}')
    assert d.item["round"] == 2 and d.item["feedback"] == ["sharper"] and d.roles == ["challenger"]
    d.answer(proposal([{"content": "x"}])).answer('{"passed": true}').judged(0.9, 0.9).answer('{"verdict": "accept"}')
    assert d.item["state"] == "ACCEPTED"


def test_audit():
    m = machine(audit=Audit(enabled=True))
    d = Drive(m).to_scores().judged(0.3, 0.8)
    assert d.item["state"] == "NEED_AUDIT" and d.roles == ["audit"] and d.rounds == [] and "0.8" in d.asked[0]["messages"][-1]["content"]
    failed = copy.deepcopy(d)
    d.answer('{"passed": true}')
    assert d.item["state"] == "ACCEPTED" and d.accepted["audit"]["passed"]
    failed.answer('{"passed": false, "failures": ["unsupported"]}')
    assert failed.item["round"] == 2 and failed.item["feedback"] == ["the audit failed: unsupported"] and failed.rounds[-1]["evaluation"]["reasons"] == ["audit:unsupported"]


def test_replays_give_the_same():
    a, b = Drive(machine()).to_scores(), Drive(machine()).to_scores()
    assert a.asked == b.asked and len({r["request_id"] for r in a.asked}) == 4


def test_redelivered_scores_count_once():
    d = Drive(machine()).to_scores().answer(weak="a", strong="b")
    r = {**{k: d.asked[0][k] for k in ("request_id", "role", "round_n", "attempt", "parent_response_id", "solver_role", "solver_text")}, "text": '{"total": 0.4}'}
    d.step(r).step(r)
    assert len(d.item["scores"]) == 1 and len(d.scores) == 1


def test_missing_grounding():
    out = machine().advance(new_item("r", "s", "plain"), [], None)
    assert out.item["state"] == "REJECTED" and "grounding" in out.item["reasons"][0]


def test_prompts_hide_the_tier():
    d = Drive(machine()).to_scores()
    texts = {json.dumps(r["messages"]) for r in d.asked}
    assert len(texts) == 1
    d.answer(weak="same", strong="same")
    assert len({json.dumps(r["messages"]) for r in d.asked}) == 1
