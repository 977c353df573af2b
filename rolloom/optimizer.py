"""The evolutionary loop: each candidate rule set is judged by the acceptance rate of whole runs."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rolloom import domains
from rolloom.functions.replies import salvage
from rolloom.operators import evolve, scoring
from rolloom.operators.evolve import SEED, Harness, Record
from rolloom.operators.store import RunStore
from rolloom.providers.client import Client
from rolloom.runner import Runner
from rolloom.sources.config import RunConfig

ASK = (
    "TASK:mutate. You improve the rules of a data generator. Given its rules and a summary of how rounds failed, change as little as would help most. "
    "Reply with one JSON object: rationale, and any of <role>_rules_add (texts) and <role>_rules_remove_indices (numbers) for the roles "
    + ", ".join(evolve.ROLES) + ", rubric_max_weight (1 to 10), require_self_test (true or false)."
)


def failures(store: RunStore, samples: int = 3) -> dict:
    """What a run's rounds failed for; zeros if it has none."""
    r = store.rounds().select(F.concat_ws("-", "item_id", F.lpad(F.col("round_n").cast("string"), 6, "0")).alias("ord"), F.col("quality.passed").alias("quality_passed"), F.col("quality.failures").alias("failures"), F.coalesce("evaluation.accepted", F.lit(None)).alias("accepted"), F.col("evaluation.reasons").alias("reasons"))
    totals, counts, first = scoring.failure_histogram(r, samples)
    t = totals.first()
    return {"total_rounds": t[0], "rejected_rounds": t[1], "reason_counts": {x["reason"]: x["n"] for x in counts.orderBy("reason").collect()}, "samples": [{"reason": x["reason"], "failures": x["failures"]} for x in first.collect()]}


@dataclass
class Outcome:
    iterations: int
    population: int
    accepted_mutations: int
    best: Harness


class Optimizer:
    def __init__(self, spark: SparkSession, config: RunConfig, rng_seed: int | None = None, handlers: str | None = None):
        m = config.metaopt
        self.spark, self.config, self.opt, self.handlers = spark, config, m, handlers
        self.rng = random.Random(rng_seed)
        self.dir = Path(config.output_dir) / m.output_subdir
        self.dir.mkdir(parents=True, exist_ok=True)
        found = domains.build(config.domain.name, config.domain.path, config.domain.params).grounding(spark).select("source_id").distinct()
        parts = {r["source_id"]: r["part"] for r in evolve.split(found, "source_id", m.train_size, m.val_size, m.val_seed).collect()}
        self.train, self.val = (sorted(k for k, v in parts.items() if v == p) for p in ("train", "val"))
        if len(self.train) < m.train_size or len(self.val) < m.val_size:
            raise ValueError(f"{m.train_size} + {m.val_size} items are needed, there are {len(parts)}")
        self.records: list[Record] = []
        self.last: RunStore | None = None

    def evaluate(self, h: Harness, ids: list[str], name: str) -> float:
        """The share of the items that a fresh run with the rules accepts."""
        rounds = min(self.config.loop.max_rounds, self.opt.inner_max_rounds)
        most = min(len(ids), self.opt.inner_max_examples_per_run) if self.opt.inner_max_examples_per_run else len(ids)
        c = replace(self.config, output_dir=str(self.dir / "runs"), resume=False, max_examples=most, loop=replace(self.config.loop, max_rounds=rounds))
        r = Runner(self.spark, c, run_id=name, harness=h, source_ids=ids, handlers=self.handlers)
        s = r.run()
        self.last = r.store
        return s.accepted / max(most, 1)

    def propose(self, parent: Harness, summary: dict) -> dict:
        """The mutator's diff; one that can't be had or read changes nothing."""
        model = self.opt.mutator or self.config.orchestrator
        ask = json.dumps({"rules": {r: list(getattr(parent, r)) for r in evolve.ROLES}, "rubric_max_weight": parent.rubric_max_weight, "require_self_test": parent.require_self_test, "failures": summary}, ensure_ascii=False)
        try:
            got = Client(handlers=self.handlers, max_retries=self.config.max_retries).complete("meta_mutator", model.provider_model, [{"role": "system", "content": ASK}, {"role": "user", "content": ask}], True, model.temperature, model.max_tokens)
            return salvage(got["text"])
        except Exception as e:
            return {"rationale": f"no mutation: {e}"}

    def run(self) -> Outcome:
        m = self.opt
        seed = Harness.from_json(Path(m.seed_harness_path).read_text()) if m.seed_harness_path else SEED
        train = self.evaluate(seed, self.train, "seed-train")
        val = self.evaluate(seed, self.val, "seed-val")
        self._add(Record(replace(seed, train_score=train, val_score=val), True, train, [val]))
        for i in range(1, m.max_iterations + 1):
            parent = evolve.select_parent(self.records, m.boltzmann_temp, self.rng)
            if len(parent.val_scores) <= m.max_val_reevals:
                parent.val_scores.append(self.evaluate(parent.harness, self.val, f"i{i}-parent-val"))
            self.evaluate(parent.harness, self.train, f"i{i}-parent-train")
            child = evolve.mutate(parent.harness, self.propose(parent.harness, failures(self.last)), i)
            if child.fingerprint() != parent.harness.fingerprint():
                train = self.evaluate(child, self.train, f"i{i}-train")
                val = self.evaluate(child, self.val, f"i{i}-val")
                self._add(Record(replace(child, train_score=train, val_score=val), val > (parent.val_mean or 0.0), train, [val]))
            self._save()
        return Outcome(m.max_iterations, len(self.records), sum(r.accepted for r in self.records) - 1, evolve.best(self.records).harness)

    def _add(self, r: Record) -> None:
        self.records.append(r)
        with (self.dir / "iterations.jsonl").open("a") as f:
            f.write(json.dumps({"harness_id": r.harness.harness_id, "parent_id": r.harness.parent_id, "iteration": r.harness.iteration, "accepted": r.accepted, "train": r.train_score, "val": r.val_scores, "rationale": r.harness.rationale}) + "\n")
        self._save()

    def _save(self) -> None:
        (self.dir / "best_harness.json").write_text(evolve.best(self.records).harness.to_json())
        (self.dir / "population.json").write_text(json.dumps([json.loads(r.harness.to_json()) | {"accepted": r.accepted, "val_scores": r.val_scores} for r in self.records], indent=1))

    def population(self):
        """The records as a table, for evolve's queries and lineage()."""
        rows = [(i, r.harness.harness_id, r.harness.parent_id, r.harness.iteration, r.accepted, r.train_score, r.val_mean) for i, r in enumerate(self.records)]
        return self.spark.createDataFrame(rows, "idx long, harness_id string, parent_id string, iteration int, accepted boolean, train_score double, val_mean double")
