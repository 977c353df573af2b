"""One step of an item: its state and the replies of its round in, the next state, requests, round and scores out.

`Machine.advance` is pure. The batch runner applies it to all items of a superstep in one cogrouped job, the
streaming runner as the update of keyed state.
"""

from __future__ import annotations

import copy
import hashlib
import json
from dataclasses import dataclass, field
from statistics import mean, pstdev
from typing import Any

from rolloom.domains.base import Domain, chat, lines
from rolloom.functions import replies
from rolloom.functions.columns import RULE_HEAD
from rolloom.operators.evolve import SEED, Harness
from rolloom.sources.config import RunConfig

TERMINAL = ("ACCEPTED", "REJECTED")


def stable_id(*parts: object, length: int = 12) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:length]


def new_item(run_id: str, source_id: str, domain: str, metadata: dict | None = None) -> dict:
    return {
        "item_id": stable_id(run_id, source_id), "run_id": run_id, "source_id": source_id, "domain": domain, "metadata": metadata or {}, "state": "PENDING", "round": 1,
        "candidate": None, "quality": None, "scores": [], "feedback": [], "history": [], "reasons": [], "pending": None, "audit": None,
    }


@dataclass
class Outcome:
    item: dict
    requests: list[dict] = field(default_factory=list)
    rounds: list[dict] = field(default_factory=list)
    scores: list[dict] = field(default_factory=list)
    accepted: dict | None = None


def side(scores: list[dict], solver: str) -> list[dict]:
    return sorted((s for s in scores if s["solver"] == solver), key=lambda s: s["attempt"])


def report(scores: list[dict]) -> dict:
    """The statistics of operators.scoring.report, for one round."""
    out: dict[str, Any] = {}
    for solver in ("weak", "strong"):
        mine = side(scores, solver)
        x = [s["total"] for s in mine] or [0.0]
        out |= {f"{solver}_n": len(mine), f"{solver}_avg": float(mean(map(_exact, x))), f"{solver}_max": max(x), f"{solver}_min": min(x), f"{solver}_std": pstdev(x)}
        out |= {f"{solver}_zeros": sum(s["total"] == 0.0 for s in mine), f"{solver}_correct": sum(s["total"] >= 1.0 for s in mine)}
    return out | {"gap": out["strong_avg"] - out["weak_avg"], "accepted": False, "reasons": [], "rationale": None}


def _exact(x: float):
    from fractions import Fraction

    return Fraction(round(x * 10**10), 10**10)


class Policy:
    """How a round is judged: by thresholds on scores, counts of right attempts, or a judge."""

    def __init__(self, config: RunConfig, domain: Domain):
        self.limits, self.mode = config.acceptance, config.acceptance.mode or domain.mode
        a, loop = config.acceptance, config.loop
        if self.mode == "verifiable":
            if not domain.verifiable:
                raise ValueError(f"domain {domain.name!r} can't verify answers")
            if a.verifiable_strong_min_correct > loop.strong_samples:
                raise ValueError("more right strong answers are asked for than there are attempts")
            if a.verifiable_weak_max_correct >= loop.weak_samples:
                raise ValueError("the weak limit lets all attempts be right")
            if a.verifiable_weak_max_correct >= a.verifiable_strong_min_correct:
                raise ValueError("the weak and strong limits leave no gap")
            self.ceiling, self.floor = a.verifiable_weak_max_correct / max(loop.weak_samples, 1), a.verifiable_strong_min_correct / max(loop.strong_samples, 1)
        else:
            self.ceiling, self.floor = a.weak_avg_max, a.strong_avg_min

    def weak_reasons(self, r: dict) -> list[str]:
        a = self.limits
        cases = (
            (r["weak_avg"] > a.weak_avg_max, f"weak_avg {r['weak_avg']:.3f} > {a.weak_avg_max}"),
            (r["weak_max"] > a.weak_max_max, f"weak_max {r['weak_max']:.3f} > {a.weak_max_max}"),
            (a.forbid_weak_zero and r["weak_zeros"] > 0, "forbid_weak_zero: a weak score is 0.0"),
        )
        return [why for bad, why in cases if bad]

    def gate(self, scores: list[dict]) -> bool:
        r = report(scores)
        if self.mode == "verifiable":
            return r["weak_correct"] <= self.limits.verifiable_weak_max_correct
        return self.mode == "judge" or not self.weak_reasons(r)

    def decide(self, scores: list[dict], quality: dict) -> dict:
        a, r = self.limits, report(scores)
        why = []
        if a.require_quality_passed and not quality["passed"]:
            why.append("quality_failed: " + (", ".join(quality["failures"]) or "unspecified"))
        if self.mode == "verifiable":
            if r["weak_correct"] > a.verifiable_weak_max_correct:
                why.append(f"weak_correct {r['weak_correct']} > {a.verifiable_weak_max_correct} (too easy)")
            if r["strong_correct"] < a.verifiable_strong_min_correct:
                why.append(f"strong_correct {r['strong_correct']} < {a.verifiable_strong_min_correct} (too hard)")
            text = f"weak {r['weak_correct']}/{r['weak_n']}, strong {r['strong_correct']}/{r['strong_n']}"
        else:
            why += self.weak_reasons(r)
            if r["strong_avg"] < a.strong_avg_min:
                why.append(f"strong_avg {r['strong_avg']:.3f} < {a.strong_avg_min}")
            if r["strong_avg"] >= a.strong_avg_max:
                why.append(f"strong_avg {r['strong_avg']:.3f} >= ceiling {a.strong_avg_max}")
            if r["gap"] < a.min_gap:
                why.append(f"gap {r['gap']:.3f} < min {a.min_gap}")
            text = f"weak {r['weak_avg']:.3f}, strong {r['strong_avg']:.3f}, gap {r['gap']:.3f}"
        return r | {"accepted": not why, "reasons": why, "rationale": None if why else text}

    @staticmethod
    def judged(scores: list[dict], verdict: dict) -> tuple[dict, list[str]]:
        r = report(scores)
        if verdict["accept"]:
            return r | {"accepted": True, "rationale": f"judge accepts ({verdict['suitability']}): {verdict['reason']}"}, []
        said = verdict["reason"].strip()
        return r | {"reasons": [f"judge wants better: {verdict['reason']}" if said else "judge wants better"]}, [verdict["suggestion"].strip() or said or "tell weak and strong answers apart better"]


class Machine:
    def __init__(self, config: RunConfig, domain: Domain, harness: Harness = SEED, safety=None):
        self.config, self.domain, self.harness = config, domain, harness
        self.policy, self.safety = Policy(config, domain), safety

    # ------------------------------------------------------------ requests

    def request(self, item: dict, role: str, messages: list[dict], attempt: int = 0, parent: str | None = None, solver: str | None = None, answer: str | None = None) -> dict:
        model = self.config.model(role)
        key = ("judge", solver, parent) if role == "judge" else (role, attempt)
        return {
            "request_id": stable_id(item["item_id"], item["round"], *key), "item_id": item["item_id"], "round_n": item["round"], "role": role, "model_key": model.provider_model, "attempt": attempt,
            "messages": self._with_rules(messages, self.harness.rules_for(role)), "json_mode": role not in ("weak", "strong"), "parent_response_id": parent, "temperature": model.temperature, "max_tokens": model.max_tokens,
            "solver_role": solver, "solver_text": answer,
        }

    @staticmethod
    def _with_rules(messages: list[dict], rules: list[str]) -> list[dict]:
        if not rules:
            return messages
        block = RULE_HEAD + lines(rules)
        first, *rest = messages or [{"role": "user", "content": ""}]
        if first["role"] != "system":
            return [first | {"role": "system", "content": block}, *messages]
        return [first | {"content": f"{first['content']}\n\n{block}"}, *rest]

    def _solvers(self, item: dict, *roles: str) -> list[dict]:
        n = {"weak": self.config.loop.weak_samples, "strong": self.config.loop.strong_samples}
        prompt = self.domain.solver_prompt(item["candidate"])
        return [self.request(item, role, prompt, k) for role in roles for k in range(n[role])]

    def _reflector(self, item: dict) -> dict:
        groups: dict[str, list] = {"failed_quality": [], "too_easy": [], "failed_strong": []}
        for r in item["history"]:
            e, about = r["evaluation"], {"round": r["round_n"], "about": replies.short_payload(r["candidate"]["payload"]) if r["candidate"] else ""}
            if not r["quality"]["passed"]:
                groups["failed_quality"].append(about | {"failures": r["quality"]["failures"]})
            elif e:
                if e["weak_avg"] > self.policy.ceiling:
                    groups["too_easy"].append(about | {"weak_avg": e["weak_avg"], "weak_std": e["weak_std"]})
                if e["strong_n"] and e["strong_avg"] < self.policy.floor:
                    groups["failed_strong"].append(about | {"strong_avg": e["strong_avg"], "gap": e["gap"]})
        ask = {"domain": self.domain.name, "leakage_rules": self.domain.leakage_rules(), "weak_limit": self.policy.ceiling, "strong_limit": self.policy.floor} | groups
        return self.request(item, "reflector", chat("TASK:reflect. Say why these rounds failed and what the next proposal should do otherwise. Reply with JSON: feedback (texts), new_angle.", json.dumps(ask, ensure_ascii=False)))

    def _evidence(self, scores: list[dict]) -> dict:
        r = report(scores)
        return {s: [round(x["total"], 3) for x in side(scores, s)] for s in ("weak", "strong")} | {k: round(r[k], 3) for k in ("weak_avg", "weak_std", "strong_avg", "strong_std", "gap")}

    # ------------------------------------------------------------ steps

    def advance(self, item: dict, responses: list[dict], grounding: dict | None) -> Outcome:
        """Replies of other rounds are ignored; without the reply that the state waits for, nothing changes."""
        if item["state"] in TERMINAL:
            return Outcome(item)
        out = Outcome(copy.deepcopy(item))
        if grounding is None:
            self._end(out, ["unrecoverable: missing grounding"])
            return out
        now = sorted((r for r in responses if r["round_n"] == item["round"]), key=lambda r: r["request_id"])
        getattr(self, "_at_" + item["state"].lower())(out, now, grounding)
        return out

    @staticmethod
    def _reply(now: list[dict], role: str) -> str | None:
        return next((r["text"] for r in now if r["role"] == role), None)

    @staticmethod
    def _end(out: Outcome, reasons: list[str]) -> None:
        out.item |= {"state": "REJECTED", "reasons": reasons or ["unspecified"]}

    def _at_pending(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        item = out.item
        prior = [r["candidate"]["payload"] for r in item["history"] if r["candidate"]]
        out.requests.append(self.request(item, "challenger", self.domain.generation_prompt(grounding, item["feedback"], item["round"], prior)))
        item["state"] = "NEED_CANDIDATE"

    def _next_round(self, out: Outcome, feedback: list[str], grounding: dict) -> None:
        out.item |= {"round": out.item["round"] + 1, "candidate": None, "quality": None, "scores": [], "feedback": feedback, "audit": None, "pending": None}
        self._at_pending(out, [], grounding)

    def _close(self, out: Outcome, quality: dict, evaluation: dict | None) -> None:
        item = out.item
        done = {"round_n": item["round"], "candidate": item["candidate"], "quality": quality, "evaluation": evaluation, "accepted": bool(evaluation and evaluation["accepted"])}
        item["history"].append(done)
        out.rounds.append(done)

    def _failed(self, out: Outcome, failures: list[str], notes: str | None = None) -> None:
        """The round ends without scores."""
        out.item["quality"] = {"passed": False, "failures": failures, "notes": notes}
        self._close(out, out.item["quality"], None)
        self._retry(out, failures)

    def _retry(self, out: Outcome, reasons: list[str]) -> None:
        if out.item["round"] < self.config.loop.max_rounds:
            out.requests.append(self._reflector(out.item))
            out.item["state"] = "NEED_REFLECTION"
        else:
            self._end(out, reasons)

    def _at_need_candidate(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        text, item = self._reply(now, "challenger"), out.item
        if text is None:
            return
        try:
            c = replies.candidate(text, self.harness.rubric_max_weight or self.config.acceptance.rubric_max_weight)
        except ValueError as e:
            return self._failed(out, [f"challenger_parse_error:{e}"])
        key = stable_id(item["source_id"], item["round"], json.dumps(c["payload"], sort_keys=True)[:200])
        item["candidate"] = c | {"candidate_id": key, "domain": item["domain"], "source_id": item["source_id"], "metadata": item["metadata"]}
        if wrong := self.domain.validate(item["candidate"]):
            return self._failed(out, wrong, "wrong shape")
        if self.config.safety.enabled and self.safety is not None:
            try:
                allowed, why = self.safety(replies.safety_text(c))
            except Exception as e:  # a user's filter: closed if it breaks
                return self._failed(out, [f"safety:filter_error:{e}"], "safety filter broke")
            if not allowed:
                return self._failed(out, [f"safety:{r}" for r in why], "safety filter")
        out.requests.append(self.request(item, "quality", self.domain.quality_prompt(item["candidate"])))
        item["state"] = "NEED_QUALITY"

    def _at_need_quality(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        text, item = self._reply(now, "quality"), out.item
        if text is None:
            return
        q = replies.check(text)
        if not q["passed"]:
            return self._failed(out, q["failures"], q["notes"])
        item |= {"state": "NEED_SCORES", "quality": q, "scores": []}
        out.requests += self._solvers(item, "weak") if self.config.loop.short_circuit_strong else self._solvers(item, "weak", "strong")

    def _at_need_scores(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        item, loop = out.item, self.config.loop
        seen = {(s["solver"], s["attempt"]) for s in item["scores"]}
        for r in now:
            solver = r["role"] if r["role"] in ("weak", "strong") else None
            if solver and self.policy.mode != "verifiable":
                out.requests.append(self.request(item, "judge", self.domain.judge_prompt(item["candidate"], r["text"]), r["attempt"], r["request_id"], solver, r["text"]))
                continue
            if r["role"] == "judge" and r.get("solver_role") and self.policy.mode != "verifiable":
                s = replies.score(r["text"], item["candidate"]["rubric"], r["solver_role"], r["attempt"], r.get("solver_text") or "") | {"solver_response_id": r.get("parent_response_id"), "judge_response_id": r["request_id"]}
            elif solver:
                s = self._verified(item["candidate"], r)
            else:
                continue
            if (s["solver"], s["attempt"]) not in seen:
                seen.add((s["solver"], s["attempt"]))
                item["scores"].append(s)
                out.scores.append(s | {"round_n": item["round"]})
        weak, strong = side(item["scores"], "weak"), side(item["scores"], "strong")
        if len(weak) < loop.weak_samples:
            return
        if loop.short_circuit_strong and loop.strong_samples > 0 and not strong:
            if self.policy.gate(weak):
                out.requests += self._solvers(item, "strong")
                return
            r = report(weak) | {"reasons": ["short_circuit: weak gate failed (too easy)"]}
            return self._decide(out, r, grounding)
        if len(strong) < loop.strong_samples:
            return
        if self.policy.mode == "judge":
            ask = {"candidate": item["candidate"]["payload"], "scores": self._evidence(item["scores"]), "quality_notes": item["quality"]["notes"]}
            out.requests.append(self.request(item, "loop_judge", chat("TASK:decide. Is this example worth keeping for training? Reply with JSON: verdict (accept or improve), reason, suggestion, suitability.", json.dumps(ask, ensure_ascii=False))))
            item["state"] = "NEED_DECISION"
            return
        self._decide(out, self.policy.decide(item["scores"], item["quality"]), grounding)

    def _verified(self, candidate: dict, r: dict) -> dict:
        s = {"solver": r["role"], "attempt": r["attempt"], "raw_response": r["text"], "total": 0.0, "per_criterion": {}, "correct": None, "solver_response_id": r["request_id"], "judge_response_id": r["request_id"]}
        try:
            ok = self.domain.verify(candidate, r["text"])
        except Exception as e:  # a user's check: wrong if it breaks
            return s | {"failure_modes": [f"verify_error:{e}"]}
        if ok is None:
            return s | {"failure_modes": ["unverifiable"]}
        return s | {"total": float(ok), "correct": bool(ok), "failure_modes": [] if ok else ["incorrect"]}

    def _at_need_decision(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        text = self._reply(now, "loop_judge")
        if text is not None:
            r, feedback = self.policy.judged(out.item["scores"], replies.verdict(text))
            self._decide(out, r, grounding, feedback=feedback, reflect=False)

    def _at_need_audit(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        text, item = self._reply(now, "audit"), out.item
        if text is None:
            return
        check, r = replies.check(text, "audit"), item["pending"]
        item |= {"audit": check, "pending": None}
        if check["passed"]:
            return self._decide(out, r, grounding, audited=True)
        failures = check["failures"] or ["unspecified"]
        reasons = ["audit:" + f for f in failures]
        r = r | {"accepted": False, "rationale": None, "reasons": reasons}
        self._decide(out, r, grounding, feedback=[f"the audit failed: {f}" for f in failures], reflect=False, audited=True)

    def _decide(self, out: Outcome, r: dict, grounding: dict, feedback: list[str] | None = None, reflect: bool = True, audited: bool = False) -> None:
        item = out.item
        if r["accepted"] and self.config.audit.enabled and not audited:
            evidence = self._evidence(item["scores"]) if self.config.audit.include_evidence else None
            prompt = self.domain.audit_prompt(item["candidate"], grounding["body"][: self.config.audit.grounding_chars], evidence)
            out.requests.append(self.request(item, "audit", prompt))
            item |= {"state": "NEED_AUDIT", "pending": r}
            return
        self._close(out, item["quality"], r)
        if r["accepted"]:
            item["state"] = "ACCEPTED"
            own = {"run_id": item["run_id"], "item_id": item["item_id"], "refinement_round": item["round"], "weak_avg": r["weak_avg"], "strong_avg": r["strong_avg"], "gap": r["gap"], "scores": side(item["scores"], "weak") + side(item["scores"], "strong"), "rationale": r["rationale"], "audit": item["audit"]}
            out.accepted = self.domain.record(item["candidate"]) | own | {"prompt": self._with_rules(self.domain.solver_prompt(item["candidate"]), self.harness.rules_for("weak"))}
        elif reflect or item["round"] >= self.config.loop.max_rounds:
            self._retry(out, r["reasons"])
        else:
            self._next_round(out, feedback or [], grounding)

    def _at_need_reflection(self, out: Outcome, now: list[dict], grounding: dict) -> None:
        text = self._reply(now, "reflector")
        if text is not None:
            self._next_round(out, replies.reflection(text), grounding)
