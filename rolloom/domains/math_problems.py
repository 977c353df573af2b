"""Word problems with one number as the answer, which can be checked."""

from __future__ import annotations

import json
import re
from fractions import Fraction

from rolloom.domains.base import Domain, chat, lines, register
from rolloom.functions.columns import NUMBER
from rolloom.sources.grounding import TOPICS, from_topics

_ANSWER = re.compile(r"answer:\s*(.+)", re.IGNORECASE)
_NUMBER = re.compile(NUMBER)


def number(text: str) -> Fraction | None:
    m = _NUMBER.search(text.replace(",", ""))
    try:
        return Fraction(m[0].rstrip(".")) if m else None
    except (ValueError, ZeroDivisionError):
        return None


@register
class MathWordProblems(Domain):
    name = "math_word_problems"
    mode = "verifiable"

    def __init__(self, topics: list[dict] | None = None, **more):
        super().__init__(topics=topics, **more)
        self.topics = topics or list(TOPICS)

    def grounding(self, spark):
        return from_topics(spark, self.topics)

    def payload_fields(self):
        return {"problem": "string", "topic": "string", "difficulty": "string"}

    def generation_prompt(self, item, feedback, round_n, prior):
        ask = f"ROUND={round_n}\nTopic and level: {item['body']}\n\nTake up these points:\n{lines(feedback)}\n\nSet before:\n{lines(prior, 'problem', 140)}"
        return chat("TASK:propose. Set one word problem whose answer is a single number, with a trap for careless solvers. Reply with one JSON object: payload (problem, topic, difficulty), reference_output (the number as text), rubric (id, description, weight from 1 to 7).", ask)

    def validate(self, candidate):
        p = candidate["payload"].get("problem")
        cases = ((not isinstance(p, str) or len(p.strip()) < 10, "problem is missing or too short"), (not candidate["reference_output"], "reference_output is missing"), (not candidate["rubric"], "rubric is empty"))
        return [why for bad, why in cases if bad]

    def solver_prompt(self, candidate):
        return chat("TASK:solve. Work it out in steps and end with a line that begins with ANSWER: and has the number.", str(candidate["payload"].get("problem")))

    def quality_prompt(self, candidate):
        return chat("TASK:check. Is the problem well posed, and is its answer one number? Reply with JSON: passed, failures, notes.", json.dumps({k: candidate[k] for k in ("payload", "reference_output", "rubric")}, ensure_ascii=False))

    def judge_prompt(self, candidate, answer):
        body = {"problem": candidate["payload"].get("problem"), "reference": candidate["reference_output"], "rubric": candidate["rubric"], "answer": answer}
        return chat("TASK:score. Equal numbers in other notation are equal. Give each criterion 0 to 1. Reply with JSON: per_criterion, total, failure_modes.", json.dumps(body, ensure_ascii=False))

    def verify(self, candidate, answer):
        said = _ANSWER.findall(answer)
        got, want = number(said[-1]) if said else None, number(candidate["reference_output"] or "")
        return None if got is None or want is None else got == want
