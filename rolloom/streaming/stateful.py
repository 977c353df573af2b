"""Items as keyed state: events (seeds and replies) in, requests and settled items out.

The event directory is append-only. A query reads what is new, updates the state of each item and appends to the
output directory; a call stage answers requests by adding event files. Both sides are idempotent: an event that
comes twice changes nothing, as requests have content ids and only the first reply counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from rolloom.operators.transition import TERMINAL, Machine, new_item
from rolloom.providers.client import CALL_SCHEMA, caller

EVENT = "item_id string, kind string, payload string"
_OUT = StructType([StructField(n, StringType()) for n in ("item_id", "kind", "payload")])


class ItemProcessor(StatefulProcessor):
    """Value state: the item, its grounding and the ids of replies it has read in this round."""

    def __init__(self, machine: Machine, max_failures: int = 3):
        self.machine, self.max_failures = machine, max_failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("item", StructType([StructField("blob", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        replies, failures = [], []
        for b in rows:
            for kind, payload in zip(b["kind"], b["payload"]):
                event = json.loads(payload)
                if kind == "seed":
                    held = held or event | {"seen": []}
                elif kind == "failure":
                    failures.append(event)
                else:
                    replies.append(event)
        if held is None or held["item"]["state"] in TERMINAL:
            return
        failed = dict(held.get("failed", {}))
        for f in failures:
            failed[f["request_id"]] = failed.get(f["request_id"], 0) + 1
        held["failed"] = failed
        dead = [f["error"] for f in failures if failed[f["request_id"]] >= self.max_failures]
        fresh = {r["request_id"]: r for r in reversed(replies) if r["request_id"] not in held["seen"]}
        try:
            out = self.machine.advance(held["item"], list(fresh.values()), held["grounding"])
            item, requests = out.item, out.requests
            if dead and item["state"] not in TERMINAL:
                item, requests = item | {"state": "REJECTED", "reasons": [f"unrecoverable: {max(dead)}"[:500]]}, []
        except Exception as e:
            item, requests = held["item"] | {"state": "REJECTED", "reasons": [f"step_error: {e}"[:500]]}, []
        seen = [*held["seen"], *fresh] if item["round"] == held["item"]["round"] else list(fresh)
        self.state.update((json.dumps(held | {"item": item, "seen": seen}),))
        emitted = [("request", json.dumps(r)) for r in requests]
        if item["state"] in TERMINAL:
            emitted.append(("settled", json.dumps(item)))
        if emitted:
            kinds, payloads = zip(*emitted)
            yield pd.DataFrame({"item_id": key[0], "kind": kinds, "payload": payloads})

    def close(self) -> None:
        pass


def advance(events: DataFrame, machine: Machine, max_failures: int = 3) -> DataFrame:
    """Requests and settled items of a stream of events; an item of which a call failed max_failures times is rejected."""
    return events.groupBy("item_id").transformWithStateInPandas(ItemProcessor(machine, max_failures), outputStructType=_OUT, outputMode="Append", timeMode="None")


class StreamRunner:
    """Runs the query and the call stage in turns until all items are settled or nothing waits."""

    def __init__(self, spark: SparkSession, path: str, machine: Machine, client: dict | None = None, concurrency: int = 4, files_per_trigger: int = 1000, max_failures: int = 3):
        self.spark, self.path, self.machine = spark, path.rstrip("/"), machine
        self.client, self.concurrency, self.files, self.max_failures = client or {}, concurrency, files_per_trigger, max_failures
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._fs_path(f"{self.path}/events"))

    def _add(self, events: DataFrame) -> None:
        """Events as new files: written aside, then moved in, so that the query never sees half a file."""
        aside = f"{self.path}/writing-{uuid.uuid4().hex}"
        events.select("item_id", "kind", "payload").write.json(aside)
        for s in self.fs.listStatus(self._fs_path(aside)):
            if s.getPath().getName().startswith("part-"):
                self.fs.rename(s.getPath(), self._fs_path(f"{self.path}/events/{uuid.uuid4().hex}.json"))
        self.fs.delete(self._fs_path(aside), True)

    def seed(self, grounding: DataFrame, run_id: str, domain: str) -> None:
        def rows(parts):
            for b in parts:
                out = []
                for s, body, m in zip(b["source_id"], b["body"], b["metadata"]):
                    item = new_item(run_id, s, domain, dict(m or {}))
                    out.append((item["item_id"], "seed", json.dumps({"item": item, "grounding": {"source_id": s, "body": body, "metadata": dict(m or {})}})))
                yield pd.DataFrame(out, columns=["item_id", "kind", "payload"])

        self._add(grounding.mapInPandas(rows, EVENT))

    def step(self) -> None:
        """Takes in all new events."""
        stream = self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", self.files).json(f"{self.path}/events")
        query = advance(stream, self.machine, self.max_failures).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    def out(self, kind: str) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.path}/out").filter(F.col("kind") == kind)

    def call(self) -> int:
        """Answers requests of open items that have no reply; their number. A call that fails is an event, too."""
        asked = self.out("request").select(F.get_json_object("payload", "$.request_id").alias("request_id"), "item_id", "payload").dropDuplicates(["request_id"])
        told = self.spark.read.schema(EVENT).json(f"{self.path}/events").filter("kind = 'reply'").select(F.get_json_object("payload", "$.request_id").alias("request_id"))
        waiting = asked.join(told, "request_id", "left_anti").join(self.out("settled").select("item_id"), "item_id", "left_anti")
        n = waiting.count()
        if n:
            said = waiting.select("request_id", "payload").repartition(self.concurrency).mapInPandas(caller(self.client), CALL_SCHEMA)
            both = said.join(waiting, "request_id")
            get = lambda k: F.get_json_object("payload", f"$.{k}")
            reply = F.struct("request_id", get("role").alias("role"), get("round_n").cast("int").alias("round_n"), get("attempt").cast("int").alias("attempt"), "text", get("parent_response_id").alias("parent_response_id"), get("solver_role").alias("solver_role"), get("solver_text").alias("solver_text"))
            bad = F.col("error").isNotNull()
            payload = F.when(bad, F.to_json(F.struct("request_id", "error"))).otherwise(F.to_json(reply, {"ignoreNullFields": "false"}))
            self._add(both.select("item_id", F.when(bad, "failure").otherwise("reply").alias("kind"), payload.alias("payload")))
        return n

    def run(self, rounds: int = 200) -> dict[str, int]:
        for _ in range(rounds):
            self.step()
            if not self.call():
                break
        return {r["s"]: r["n"] for r in self.out("settled").dropDuplicates(["item_id"]).groupBy(F.get_json_object("payload", "$.state").alias("s")).agg(F.count("*").alias("n")).collect()}
