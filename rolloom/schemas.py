"""Schemas of the logs and of what they hold."""

from __future__ import annotations

SCORE = "struct<solver:string,attempt:int,raw_response:string,total:double,per_criterion:map<string,double>,failure_modes:array<string>,correct:boolean,solver_response_id:string,judge_response_id:string>"
CRITERION = "struct<id:string,description:string,weight:int>"
MESSAGE = "struct<role:string,content:string>"
CHECK = "struct<passed:boolean,failures:array<string>,notes:string>"
REPORT = "struct<weak_n:int,weak_avg:double,weak_max:double,weak_min:double,weak_std:double,weak_zeros:int,weak_correct:int,strong_n:int,strong_avg:double,strong_max:double,strong_min:double,strong_std:double,strong_zeros:int,strong_correct:int,gap:double,accepted:boolean,reasons:array<string>,rationale:string>"

REQUEST = f"request_id string, item_id string, round_n int, role string, model_key string, attempt int, messages array<{MESSAGE}>, json_mode boolean, parent_response_id string, temperature double, max_tokens int"
ITEM = "item_id string, run_id string, source_id string, domain string, state string, round int, reasons array<string>"
ROUND = f"round_n int, quality {CHECK}, evaluation {REPORT}, accepted boolean"
ACCEPTED = f"run_id string, item_id string, source_id string, domain string, refinement_round int, reference_output string, rubric array<{CRITERION}>, weak_avg double, strong_avg double, gap double, rationale string, audit {CHECK}, scores array<{SCORE}>, prompt array<{MESSAGE}>"

#: The logs: each append is a directory, written aside and renamed.
LOGS = {
    "runs": "run_id string, event string, config string, harness string, at timestamp",
    "grounding": "source_id string, body string, metadata map<string,string>",
    "steps": "item_id string, kind string, payload string, consumed_seq long",
    "calls": "request_id string, model string, text string, prompt_tokens long, completion_tokens long, cost_usd double, duration_ms long, error string",
    "tags": "request_id string, batch_id string",
}
VERSION = 1
