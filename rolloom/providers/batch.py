"""Batches: requests as lines, replies as rows, and providers that take and return them."""

from __future__ import annotations

import json
import os
import uuid
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions.columns import model_name

REPLY = "custom_id string, error struct<message:string>, response struct<status_code:int,body:struct<model:string,choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:int,completion_tokens:int>,error:struct<message:string>>>"
MESSAGES_REPLY = "custom_id string, result struct<type:string,error:struct<message:string>,message:struct<model:string,content:array<struct<type:string,text:string>>,usage:struct<input_tokens:int,output_tokens:int>>>"
DEFAULT_MAX_TOKENS = 4096


def line() -> Column:
    """A request row as a line of the files that OpenAI's batches take; what is null is left out."""
    body = F.struct(
        model_name("model_key").alias("model"), "messages", "temperature", "max_tokens",
        F.when(F.col("json_mode"), F.struct(F.lit("json_object").alias("type"))).alias("response_format"),
    )
    return F.to_json(F.struct(F.col("request_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def messages_request() -> Column:
    """A request row as Anthropic's batches take it: system messages apart, max_tokens always given."""
    system = F.nullif(F.array_join(F.transform(F.filter("messages", lambda m: m.role == "system"), lambda m: m.content), "\n\n"), F.lit(""))
    params = F.struct(
        model_name("model_key").alias("model"), F.coalesce(F.nullif("max_tokens", F.lit(0)), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        system.alias("system"), F.filter("messages", lambda m: m.role != "system").alias("messages"), "temperature",
    )
    return F.to_json(F.struct(F.col("request_id").alias("custom_id"), params.alias("params")))


def reply(text: Column) -> Column:
    """struct(request_id, model, text, prompt_tokens, completion_tokens, error) of a line that OpenAI returns."""
    r = F.from_json(text, REPLY)
    status = r.response.status_code
    bad = r.error.isNotNull() | r.response.isNull() | (status.isNotNull() & (status != 200))
    why = F.coalesce(r.error.message, r.response.body.error.message, F.concat(F.lit("status "), status.cast("string")), F.lit("no response"))
    body = r.response.body
    return F.struct(r.custom_id.alias("request_id"), body.model.alias("model"), F.coalesce(F.try_element_at(body.choices, F.lit(1)).message.content, F.lit("")).alias("text"), body.usage.prompt_tokens.alias("prompt_tokens"), body.usage.completion_tokens.alias("completion_tokens"), F.when(bad, why).alias("error"))


def messages_reply(text: Column) -> Column:
    """The same of a line that Anthropic returns: its text blocks, one after the other."""
    r = F.from_json(text, MESSAGES_REPLY)
    m = r.result.message
    said = F.array_join(F.transform(F.filter(m.content, lambda b: b.type == "text"), lambda b: b.text), "")
    why = F.coalesce(r.result.error.message, r.result.type, F.lit("no result"))
    return F.struct(r.custom_id.alias("request_id"), m.model.alias("model"), said.alias("text"), m.usage.input_tokens.alias("prompt_tokens"), m.usage.output_tokens.alias("completion_tokens"), F.when(~F.coalesce(r.result.type == "succeeded", F.lit(False)), why).alias("error"))


class BatchProvider(Protocol):
    """Takes lines, says when they are done and gives lines back. `decode` makes a row of such a line."""

    name: str

    def encode(self) -> Column: ...
    def decode(self, text: Column) -> Column: ...
    def submit(self, lines: list[str]) -> str: ...
    def is_complete(self, batch_id: str) -> bool: ...
    def fetch(self, batch_id: str) -> list[str]: ...


class MockBatch:
    """Answers by a handler (role, messages), ready after some polls; a batch is fetched once."""

    name = "mock"

    def __init__(self, handler, polls: int = 1):
        self.handler, self.polls = handler, polls
        self.held: dict[str, tuple[list[str], int]] = {}

    encode = staticmethod(line)
    decode = staticmethod(reply)

    def submit(self, lines: list[str]) -> str:
        batch_id = f"mock-{uuid.uuid4().hex[:10]}"
        self.held[batch_id] = (lines, self.polls)
        return batch_id

    def is_complete(self, batch_id: str) -> bool:
        lines, left = self.held[batch_id]
        self.held[batch_id] = (lines, left - 1)
        return left <= 1

    def fetch(self, batch_id: str) -> list[str]:
        out = []
        for raw in self.held.pop(batch_id)[0]:
            r = json.loads(raw)
            text = self.handler(None, r["body"]["messages"])
            body = dict(model=r["body"]["model"], usage=dict(prompt_tokens=1, completion_tokens=1), choices=[dict(message=dict(content=text))])
            out.append(json.dumps(dict(custom_id=r["custom_id"], response=dict(status_code=200, body=body))))
        return out


class OpenAIBatch:
    """Needs the library of that name, which is imported at the first call."""

    name = "openai"
    encode = staticmethod(line)
    decode = staticmethod(reply)
    ENDED = ("completed", "failed", "expired", "cancelled")

    def __init__(self, window: str = "24h"):
        self.window = window

    @property
    def _client(self):
        from openai import OpenAI

        return OpenAI()

    def submit(self, lines: list[str]) -> str:
        file = self._client.files.create(file=("requests.jsonl", "\n".join(lines).encode()), purpose="batch")
        return self._client.batches.create(input_file_id=file.id, endpoint="/v1/chat/completions", completion_window=self.window).id

    def is_complete(self, batch_id: str) -> bool:
        status = self._client.batches.retrieve(batch_id).status
        return status in self.ENDED

    def fetch(self, batch_id: str) -> list[str]:
        b = self._client.batches.retrieve(batch_id)
        files = [f for f in (b.output_file_id, b.error_file_id) if f]
        return [x for f in files for x in self._client.files.content(f).text.splitlines() if x.strip()]


class AnthropicBatch:
    """Over plain HTTP, with the key in ANTHROPIC_API_KEY."""

    name = "anthropic"
    encode = staticmethod(messages_request)
    decode = staticmethod(messages_reply)
    VERSION = "2023-06-01"
    KEY, URL = "ANTHROPIC_API_KEY", "https://api.anthropic.com/v1/messages/batches"

    def _call(self, url: str, body: dict | None = None) -> str:
        import urllib.request

        if not (key := os.getenv(self.KEY)):
            raise RuntimeError(f"{self.KEY} isn't set")
        head = {"content-type": "application/json", "x-api-key": key} | {"anthropic-version": self.VERSION}
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode(), head), timeout=120) as f:
            return f.read().decode()

    def submit(self, lines: list[str]) -> str:
        return json.loads(self._call(self.URL, {"requests": [json.loads(x) for x in lines]}))["id"]

    def is_complete(self, batch_id: str) -> bool:
        status = json.loads(self._call(f"{self.URL}/{batch_id}"))["processing_status"]
        return status == "ended"

    def fetch(self, batch_id: str) -> list[str]:
        return [x for x in self._call(f"{self.URL}/{batch_id}/results").splitlines() if x.strip()]


def provider(name: str, window: str = "24h") -> BatchProvider:
    if name == "openai":
        return OpenAIBatch(window)
    if name == "anthropic":
        return AnthropicBatch()
    raise ValueError(f"no batch provider {name!r}")
