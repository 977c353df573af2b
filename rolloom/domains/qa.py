"""Questions that only a reader of the document can answer."""

from __future__ import annotations

import json

from rolloom.domains.base import Domain, chat, lines, register
from rolloom.sources.grounding import BODY_CHARS, SUFFIXES, from_files


@register
class QaFromDocuments(Domain):
    name = "qa_from_documents"

    def __init__(self, docs_path: str = ".", glob: str | None = None, max_chars: int = BODY_CHARS, suffixes=SUFFIXES, **more):
        super().__init__(docs_path=docs_path, glob=glob, max_chars=max_chars, **more)
        self.docs_path, self.glob, self.max_chars, self.suffixes = docs_path, glob, max_chars, tuple(suffixes)

    def grounding(self, spark):
        return from_files(spark, self.docs_path, self.glob, self.suffixes, self.max_chars)

    def payload_fields(self):
        return {"question": "string", "context": "string", "reasoning_skills": "array"}

    def generation_prompt(self, item, feedback, round_n, prior):
        ask = f"ROUND={round_n}\nSource:\n{item['body']}\n\nTake up these points:\n{lines(feedback)}\n\nAsked before, don't ask again:\n{lines(prior, 'question', 140)}"
        return chat("TASK:propose. Write one question on the source, hard for a hasty reader and fair to a careful one. Reply with one JSON object: payload (question, context, reasoning_skills), reference_output, rubric (id, description, weight from 1 to 7).", ask)

    def validate(self, candidate):
        q, r = candidate["payload"].get("question"), candidate["reference_output"]
        cases = (
            (not isinstance(q, str) or len(q.strip()) < 5, "question is missing or too short"),
            (not isinstance(r, str) or len(r.strip()) < 5, "reference_output is missing or too short"),
            (not candidate["rubric"], "rubric is empty"),
        )
        return [why for bad, why in cases if bad]

    def solver_prompt(self, candidate):
        p = candidate["payload"]
        return chat("TASK:solve. Answer the question from the context and say how you got there.", f"Context:\n{p.get('context') or ''}\n\nQuestion: {p.get('question')}")

    def quality_prompt(self, candidate):
        return chat("TASK:check. Is the question clear, does it need the source, and does the context keep the answer to itself? Reply with JSON: passed, failures, notes.", json.dumps({k: candidate[k] for k in ("payload", "reference_output", "rubric")}, ensure_ascii=False))

    def judge_prompt(self, candidate, answer):
        body = {"question": candidate["payload"].get("question"), "reference": candidate["reference_output"], "rubric": candidate["rubric"], "answer": answer}
        return chat("TASK:score. Give each criterion 0 to 1. Reply with JSON: per_criterion, total, failure_modes.", json.dumps(body, ensure_ascii=False))

    def leakage_rules(self):
        return ["The context must not state the answer.", "The question must not suggest it.", "General knowledge must not be enough."]
