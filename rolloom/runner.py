"""A run in supersteps: each advances all items that can, then answers all requests that wait."""

from __future__ import annotations

import json
import signal
import time
import warnings
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom import domains, schemas
from rolloom.functions.safety import load_filter
from rolloom.operators import logs
from rolloom.operators.evolve import SEED, Harness
from rolloom.operators.store import RunStore
from rolloom.operators.transition import Machine, new_item, stable_id
from rolloom.providers import batch as batches
from rolloom.providers.client import CALL_SCHEMA, caller
from rolloom.sources import config as settings
from rolloom.sources.config import RunConfig

STEP_SCHEMA = schemas.LOGS["steps"]

#: Share of the budget from which on a run says so, once.
WARN_AT = 0.8


@dataclass
class Summary:
    run_id: str
    accepted: int
    rejected: int
    states: dict[str, int]
    cost_usd: float
    supersteps: int = 0
    status: str = "completed"


def outcome_rows(item_id: str, out, consumed: int | None) -> pd.DataFrame:
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    rows = [(item_id, "request", dump(r), None) for r in out.requests] + [(item_id, "round", dump(r), None) for r in out.rounds] + [(item_id, "score", dump(s), None) for s in out.scores]
    if out.accepted is not None:
        rows.append((item_id, "accepted", dump(out.accepted), None))
    rows.append((item_id, "item", dump(out.item), consumed))
    return pd.DataFrame(rows, columns=["item_id", "kind", "payload", "consumed_seq"]).astype({"consumed_seq": "Int64"})


def stepper(machine: Machine):
    """For cogrouped items (blob, body, metadata) and responses: the rows of the step. A step that breaks rejects its item."""

    def run(items: pd.DataFrame, responses: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"item_id": [], "kind": [], "payload": [], "consumed_seq": pd.Series([], dtype="Int64")})
        row = items.iloc[0]
        item = json.loads(row["blob"])
        grounding = None if pd.isna(row["body"]) else {"source_id": item["source_id"], "body": row["body"], "metadata": item["metadata"]}
        known = responses.astype(object).where(responses.notna(), None).to_dict("records")
        consumed = int(responses["seq"].max()) if len(responses) else None
        try:
            out = machine.advance(item, known, grounding)
        except Exception as e:
            out = SimpleNamespace(item=item | {"state": "REJECTED", "reasons": [f"step_error: {type(e).__name__}: {e}"[:500]]}, requests=[], rounds=[], scores=[], accepted=None)
        return outcome_rows(item["item_id"], out, consumed)

    return run


@dataclass
class Runner:
    spark: SparkSession
    config: RunConfig
    run_id: str | None = None
    harness: Harness = SEED
    source_ids: list[str] | None = None
    batch_provider: object | None = None
    handlers: str | None = None
    sleep: object = time.sleep
    stopping: bool = field(default=False, init=False)
    warned: bool = field(default=False, init=False)

    def __post_init__(self):
        c = self.config
        self.run_id = self.run_id or c.run_id or f"run-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{stable_id(c.domain, time.time_ns(), length=6)}"
        self.path = f"{c.output_dir.rstrip('/')}/{self.run_id}"
        self.domain = domains.build(c.domain.name, c.domain.path, c.domain.params)
        self.store = RunStore(self.spark, self.path, c.dispatcher.max_request_failures)
        self.machine = Machine(c, self.domain, self.harness, load_filter(c.safety.filter) if c.safety.enabled else None)

    # ------------------------------------------------------------ start

    def seed(self) -> None:
        """Stores the grounding and the items that aren't there yet, up to max_examples in the order of the ids."""
        found = self.domain.grounding(self.spark)
        if self.source_ids is not None:
            found = found.filter(F.col("source_id").isin(self.source_ids))
        found = found.dropDuplicates(["source_id"]).orderBy("source_id").limit(self.config.max_examples)
        fresh = logs.insert_if_absent(found, self.store.log("grounding"), ["source_id"])
        self.store.append("grounding", fresh)
        have = self.store.items().select("source_id")
        run_id, name = self.run_id, self.domain.name

        def rows(parts):
            for b in parts:
                blobs = [new_item(run_id, s, name, dict(m or {})) for s, m in zip(b["source_id"], b["metadata"])]
                yield pd.DataFrame({"item_id": [x["item_id"] for x in blobs], "kind": "item", "payload": [json.dumps(x, ensure_ascii=False) for x in blobs], "consumed_seq": pd.Series([None] * len(blobs), dtype="Int64")})

        new = self.store.log("grounding").dropDuplicates(["source_id"]).join(have, "source_id", "left_anti").select("source_id", "metadata")
        self.store.append("steps", new.mapInPandas(rows, STEP_SCHEMA))

    # ------------------------------------------------------------ one superstep

    def advance(self) -> int:
        """One job over all items that are new or have unread replies; their number."""
        items = self.store.items()
        hydrated = self.store.hydrated()
        open_ = logs.open_(items)
        work = open_.filter("state = 'PENDING'").unionByName(logs.ready(open_.filter("state <> 'PENDING'"), hydrated))
        grounding = self.store.log("grounding").groupBy("source_id").agg(F.min_by("body", "seq").alias("body"))
        work = work.join(grounding, "source_id", "left").select("item_id", "blob", "body", "consumed_seq")
        unread = hydrated.join(work.select("item_id", "consumed_seq"), "item_id").filter(F.col("seq") > F.coalesce("consumed_seq", F.lit(-1)))
        unread = unread.select("item_id", "request_id", "role", "round_n", "attempt", "text", "parent_response_id", "solver_role", "solver_text", "seq")
        done = work.groupBy("item_id").cogroup(unread.groupBy("item_id")).applyInPandas(stepper(self.machine), STEP_SCHEMA)
        return self.store.append("steps", done).filter("kind = 'item'").count()

    def dead_letters(self) -> None:
        """Items with a request that failed for good are rejected."""
        bad = logs.unrecoverable(self.store.items(), self.store.requests(), self.config.dispatcher.max_request_failures)
        lost = self.store.items().join(bad, "item_id").select("item_id", "blob", "error")
        if lost.isEmpty():
            return

        def rows(parts):
            for b in parts:
                blobs = [json.dumps(json.loads(x) | {"state": "REJECTED", "reasons": [f"unrecoverable: {e}"]}, ensure_ascii=False) for x, e in zip(b["blob"], b["error"])]
                yield pd.DataFrame({"item_id": b["item_id"], "kind": "item", "payload": blobs, "consumed_seq": pd.Series([None] * len(b), dtype="Int64")})

        self.store.append("steps", lost.mapInPandas(rows, STEP_SCHEMA))

    def call(self) -> int:
        """Answers the first requests that wait, `batch_size` at most, on `concurrency` partitions; their number."""
        d = self.config.dispatcher
        waiting = logs.claim(self.store.requests(), d.batch_size).select("request_id", "payload")
        extra = {m.provider_model: m.extra for m in (self.config.model(r) for r in ("challenger", "weak", "strong", "reflector", "audit", "judge")) if m.extra}
        make = {"limits": self.config.rate_limits, "prices": {k: tuple(v) for k, v in self.config.prices.items()}, "timeout_s": self.config.request_timeout_s, "max_retries": self.config.max_retries, "share": d.concurrency, "extra": extra, "handlers": self.handlers}
        return self.store.append("calls", waiting.repartition(d.concurrency).mapInPandas(caller(make), CALL_SCHEMA)).count()

    def submit(self) -> int:
        """Hands what waits to the provider of batches, one batch for each provider prefix; a refused batch fails its requests."""
        waiting = logs.claim(self.store.requests(), self.config.dispatcher.batch_size)
        p = self.batch_provider
        rows = waiting.select("request_id", p.encode().alias("line"), F.split_part("model_key", F.lit("/"), F.lit(1)).alias("who")).collect()  # at most batch_size
        for who in sorted({r["who"] for r in rows}):
            mine = [r for r in rows if r["who"] == who]
            try:
                batch_id = p.submit([r["line"] for r in mine])
                self.store.append("tags", self.spark.createDataFrame([(r["request_id"], batch_id) for r in mine], schemas.LOGS["tags"]))
            except Exception as e:
                self._fail([r["request_id"] for r in mine], f"submit: {e}")
        return len(rows)

    def _fail(self, ids: list[str], why: str) -> None:
        rows = [(i, None, None, None, None, None, None, why[:500]) for i in ids]
        self.store.append("calls", self.spark.createDataFrame(rows, CALL_SCHEMA))

    def poll(self) -> int:
        """Takes in the batches that are done: replies by id; ids without one have failed, ids nobody asked for are passed over."""
        requests = self.store.requests()
        flying = requests.filter("status = 'in_flight'")
        taken = 0
        for (batch_id,) in flying.select("batch_id").distinct().collect():
            p = self.batch_provider
            try:
                if not p.is_complete(batch_id):
                    continue
                lines = p.fetch(batch_id)
            except Exception as e:
                lines, why = [], f"fetch: {e}"
            else:
                why = "the batch has no reply"
            mine = flying.filter(F.col("batch_id") == batch_id).select("request_id")
            got = self.spark.createDataFrame([(x,) for x in lines], "line string").select(p.decode(F.col("line")).alias("r")).select("r.*")
            outcome = logs.reconcile(mine, got).filter("outcome <> 'unknown'")
            back = outcome.join(got.dropDuplicates(["request_id"]), "request_id", "left")
            error = F.when(F.col("outcome") == "missing", why).when(F.col("outcome") == "failed", F.col("error"))
            calls = back.select("request_id", "model", "text", F.col("prompt_tokens").cast("long"), F.col("completion_tokens").cast("long"), self._price(back), F.lit(None).cast("long").alias("duration_ms"), error.alias("error"))
            taken += self.store.append("calls", calls).count()
            self.store.append("tags", mine.withColumn("batch_id", F.lit(None).cast("string")))
        return taken

    def _price(self, _df: DataFrame):
        out = F.lit(None).cast("double")
        for model, (a, b) in self.config.prices.items():
            out = F.when(F.col("model") == model.split("/", 1)[-1], (F.col("prompt_tokens") * a + F.col("completion_tokens") * b) / 1e6).otherwise(out)
        return out.alias("cost_usd")

    # ------------------------------------------------------------ the loop

    def run(self, max_supersteps: int | None = None) -> Summary:
        """Until all items are settled, nothing moves, the budget is spent, the run is told to stop or the supersteps are used up."""
        c = self.config
        before = self.store.run()
        if before and not c.resume:
            raise RuntimeError(f"{self.run_id} exists and resume is off")
        if self.path.startswith("/") or "://" not in self.path:
            Path(self.path).mkdir(parents=True, exist_ok=True)
            settings.write_snapshot(replace(c, run_id=self.run_id), f"{self.path}/config.snapshot.yaml")
        self.store.mark(self.run_id, "running", asdict(c), self.harness.to_json())
        self.seed()
        old = self._signals()
        status, n = "completed", 0
        try:
            while not self.stopping:
                moved = self.advance()
                if c.budget_usd is not None:
                    spent = self.store.cost()
                    if spent >= c.budget_usd:
                        status = "aborted"
                        break
                    if spent >= WARN_AT * c.budget_usd and not self.warned:
                        self.warned = True
                        warnings.warn(f"{self.run_id} has spent {spent:.4f} of {c.budget_usd:.4f} USD", stacklevel=2)
                n += 1
                if self.batch_provider is not None:
                    moved += self.submit() + self.poll()
                else:
                    moved += self.call()
                self.dead_letters()
                states = self.states()
                if not sum(v for k, v in states.items() if k not in logs.TERMINAL):
                    break
                if max_supersteps is not None and n >= max_supersteps:
                    status = "running"
                    break
                if not moved:
                    flying = self.batch_provider is not None and not self.store.requests().filter("status = 'in_flight'").isEmpty()
                    if not flying:
                        status = "stalled"
                        break
                    self.sleep(c.dispatcher.poll_interval_s)
            else:
                status = "stopped"
        finally:
            for s, h in old.items():
                signal.signal(s, h)
        self.store.mark(self.run_id, status)
        return self.summary(n, status)

    def _signals(self) -> dict:
        def stop(*_):
            self.stopping = True

        try:
            return {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
        except ValueError:  # not in the main thread
            return {}

    def states(self) -> dict[str, int]:
        return {r["state"]: r["n"] for r in logs.state_counts(self.store.items()).collect()}

    def summary(self, supersteps: int = 0, status: str = "completed") -> Summary:
        s = self.states()
        return Summary(self.run_id, s.get("ACCEPTED", 0), s.get("REJECTED", 0), s, self.store.cost(), supersteps, status)


def batch_provider_for(config: RunConfig):
    """None in local mode."""
    d = config.dispatcher
    return batches.provider(d.batch_provider, d.batch_completion_window) if d.mode == "batch" else None
