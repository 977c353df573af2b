from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rolloom.providers import batch, mock
from rolloom.providers.client import Bucket, Client, limit_for, retryable


def test_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = Bucket(60, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        b.take()
    assert sum(slept) == pytest.approx(2.0)
    assert Bucket(3).burst == 1.0 and Bucket(400).burst == 100


def test_limits_and_prices():
    limits = {"a/*": 1, "a/b": 2, "*": 3}
    assert [limit_for(limits, m) for m in ("a/b", "a/c", "z")] == [2, 1, 3] and limit_for({}, "x") is None
    got = Client(prices={"mock/*": (1e6, 2e6)}).complete("weak", "mock/default", [{"role": "user", "content": "one two"}])
    assert got["cost_usd"] == got["prompt_tokens"] + 2 * got["completion_tokens"] and got["prompt_tokens"] == 2


def test_retryable():
    class RateLimit(Exception):
        status_code = 429

    class AuthenticationError(Exception):
        status_code = 500

    class Bad(Exception):
        status_code = 400

    assert retryable(RateLimit()) and retryable(ConnectionError()) and not retryable(AuthenticationError()) and not retryable(Bad()) and not retryable(ValueError())


def test_mock():
    assert mock.role_of(None, [{"content": "TASK:score x"}]) == "judge" and mock.round_of([{"content": "ROUND=3"}]) == 3
    assert mock.handler("no such") is mock.handler("default")
    json.loads(mock.handler("default")("judge", [{"content": "strong answer 1"}]))


REQUEST = "request_id string, model_key string, messages array<struct<role:string,content:string>>, json_mode boolean, temperature double, max_tokens int"


def test_lines(spark):
    rows = [("a", "openai/m", [("system", "s"), ("user", "u"), ("system", "t")], True, 0.5, 10), ("b", "m", [("user", "u")], False, None, None)]
    df = spark.createDataFrame(rows, REQUEST)
    one, two = (json.loads(r.x) for r in df.select(batch.line().alias("x")).collect())
    assert one["custom_id"] == "a" and one["body"]["model"] == "m" and one["body"]["response_format"] == {"type": "json_object"} and one["body"]["max_tokens"] == 10
    assert set(two["body"]) == {"model", "messages"}
    one, two = (json.loads(r.x)["params"] for r in df.select(batch.messages_request().alias("x")).collect())
    assert one["system"] == "s\n\nt" and [m["role"] for m in one["messages"]] == ["user"] and one["max_tokens"] == 10
    assert "system" not in two and two["max_tokens"] == 4096


def test_replies(spark):
    good = {"custom_id": "a", "response": {"status_code": 200, "body": {"model": "m", "choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}}}
    lines = [good, {"custom_id": "b", "error": {"message": "no"}}, {"custom_id": "c"}, {"custom_id": "d", "response": {"status_code": 500, "body": {}}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "t string").select(batch.reply(F.col("t")).alias("r")).select("r.*")
    got = {r.request_id: r for r in df.collect()}
    assert got["a"].text == "hi" and got["a"].error is None and got["b"].error == "no" and got["c"].error == "no response" and got["d"].error == "status 500"
    lines = [{"custom_id": "a", "result": {"type": "succeeded", "message": {"model": "m", "content": [{"type": "text", "text": "x"}, {"type": "tool", "text": "-"}, {"type": "text", "text": "y"}], "usage": {"input_tokens": 1, "output_tokens": 2}}}}, {"custom_id": "b", "result": {"type": "expired"}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "t string").select(batch.messages_reply(F.col("t")).alias("r")).select("r.*")
    got = {r.request_id: r for r in df.collect()}
    assert got["a"].text == "xy" and got["a"].error is None and got["b"].error == "expired"


def test_providers():
    with pytest.raises(ValueError):
        batch.provider("nobody")
    p = batch.MockBatch(lambda role, m: "x", polls=2)
    b = p.submit([json.dumps({"custom_id": "a", "body": {"model": "m", "messages": []}})])
    assert not p.is_complete(b) and p.is_complete(b) and json.loads(p.fetch(b)[0])["custom_id"] == "a"
    with pytest.raises(KeyError):
        p.fetch(b)


class Library:
    """Stands in for the library of live calls."""

    def __init__(self, strict=True, cost=0.25):
        self.strict, self.cost, self.asked = strict, cost, []

    def supports_response_schema(self, model):
        if self.strict is None:
            raise KeyError(model)
        return self.strict

    def completion(self, **args):
        self.asked.append(args)
        from types import SimpleNamespace as N

        return N(model=None, choices=[N(message=N(content="{}"))], usage=N(prompt_tokens=10, completion_tokens=5))

    def completion_cost(self, completion_response, model):
        if self.cost is None:
            raise ValueError(model)
        return self.cost


def test_formats():
    from rolloom.providers import formats

    payload = formats.strict(question=formats.TEXT)
    for role, schema, is_strict in (("quality", None, True), ("reflector", None, True), ("loop_judge", None, True), ("judge", None, False), ("nobody", None, False), ("challenger", None, False), ("challenger", payload, True)):
        got = formats.response_format(Library(), role, "m", schema)
        assert got["type"] == ("json_schema" if is_strict else "json_object"), role
        if is_strict:
            assert got["json_schema"]["strict"] and not formats.has_open_map(got["json_schema"]["schema"])
        assert formats.response_format(Library(False), role, "m", schema) == formats.response_format(Library(None), role, "m", schema) == {"type": "json_object"}
    assert formats.candidate(payload)["properties"]["payload"] == payload
    assert formats.has_open_map({"properties": {"a": {"type": "array", "items": {"type": "object", "additionalProperties": {"type": "string"}}}}})
    assert formats.has_open_map({"type": "object"}) and not formats.has_open_map(formats.SCHEMAS["quality"])


def test_cost_and_format_of_live_calls(monkeypatch):
    import sys

    from rolloom.providers.client import Client

    for cost, prices, want in ((0.25, {}, 0.25), (None, {}, None), (0.25, {"live/*": (1e6, 2e6)}, 20.0)):
        monkeypatch.setitem(sys.modules, "litellm", lib := Library(cost=cost))
        got = Client(prices=prices).complete("quality", "live/x", [{"role": "user", "content": "q"}], json_mode=True)
        assert got["cost_usd"] == want and lib.asked[0]["response_format"]["type"] == "json_schema"
        Client().complete("weak", "live/x", [{"role": "user", "content": "q"}])
        assert "response_format" not in lib.asked[1]


def test_mock_models_keep_their_rate():
    from rolloom.providers.client import Client

    waits = []
    c = Client(limits={"mock/*": 60}, sleep=lambda s: waits.append(s) or __import__("time").sleep(0.02) if len(waits) < 3 else __import__("time").sleep(s))
    for _ in range(16):
        c.complete("quality", "mock/default", [{"role": "user", "content": "q"}])
    assert waits


def test_public_names():
    import rolloom

    assert {"Runner", "RunConfig", "Machine", "MockBatch"} <= set(dir(rolloom)) and all(getattr(rolloom, n) is not None for n in rolloom.__all__)
    with pytest.raises(AttributeError):
        rolloom.Nothing
