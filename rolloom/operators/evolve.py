"""The outer loop over rule sets: rates, selection, mutation, splits."""

from __future__ import annotations

import hashlib
import json
import math
import random
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.columns import stable_id

ROLES = tuple("audit challenger judge quality reflector solver".split())


# ---------------------------------------------------------------- over tables


def acceptance_rate(verdicts: DataFrame, *keys: str) -> DataFrame:
    """accepted / max(n, 1) by key."""
    return verdicts.groupBy(*keys).agg((F.count_if("accepted") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def softmax_pick(records: DataFrame, temperature: float, r: float) -> DataFrame:
    """records (idx, score) with share, their softmax weight, and picked: the first whose running share reaches r.

    The population is small by nature, a record for each accepted rule set, so one task sums it.
    """
    every, so_far = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    w = records.withColumn("_w", F.exp((F.coalesce("score", F.lit(0.0)) - F.max(F.coalesce("score", F.lit(0.0))).over(every)) / max(temperature, 1e-6)))
    c = w.withColumns({"share": F.col("_w") / F.sum("_w").over(every), "_cum": F.sum("_w").over(so_far) / F.sum("_w").over(every)})
    first = F.coalesce(F.min(F.when(F.col("_cum") >= r, F.col("idx"))).over(every), F.max("idx").over(every))
    return c.withColumn("picked", F.col("idx") == first).drop("_w", "_cum")


def best_record(records: DataFrame, *keys: str) -> DataFrame:
    """Of the accepted (idx, val_mean, train_score), by key, the best by validation, then training; of equals the first."""
    return records.filter("accepted").groupBy(*keys).agg(F.max_by("idx", F.struct(F.coalesce("val_mean", F.lit(0.0)), F.coalesce("train_score", F.lit(0.0)), -F.col("idx"))).alias("idx"))


def split(ids: DataFrame, key: str, train: int, val: int, seed: int) -> DataFrame:
    """(key, part): train and val ids, first by a seeded hash."""
    order = ids.withColumn("_h", F.sha2(F.concat_ws("|", F.lit("seed"), F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(train + val)
    n = F.row_number().over(Window.orderBy("_h", key))
    return order.withColumn("_n", n).select(key, F.when(F.col("_n") <= train, "train").otherwise("val").alias("part"))


def lineage(records: DataFrame, harness_id: str) -> DataFrame:
    """(harness_id, depth): a rule set and its ancestors, by a recursive query."""
    records.createOrReplaceTempView("_rolloom_records")
    return records.sparkSession.sql(
        "WITH RECURSIVE up(harness_id, parent_id, depth) AS (SELECT harness_id, parent_id, 0 FROM _rolloom_records WHERE harness_id = :id"
        " UNION ALL SELECT r.harness_id, r.parent_id, depth + 1 FROM _rolloom_records r JOIN up ON r.harness_id = up.parent_id) SELECT harness_id, depth FROM up",
        args={"id": harness_id},
    )


# ---------------------------------------------------------------- rule sets


@dataclass(frozen=True)
class Harness:
    """Rules by role and two knobs. Ids follow from the content."""

    challenger: tuple[str, ...] = ()
    quality: tuple[str, ...] = ()
    judge: tuple[str, ...] = ()
    solver: tuple[str, ...] = ()
    reflector: tuple[str, ...] = ()
    audit: tuple[str, ...] = ()
    rubric_max_weight: int = 7
    require_self_test: bool = False
    iteration: int = 0
    parent_id: str | None = None
    val_score: float | None = None
    train_score: float | None = None
    rationale: str = ""

    @property
    def harness_id(self) -> str:
        return _digest("h", self.iteration, self.parent_id or "", self._content())

    def _content(self) -> str:
        kept = {r: list(getattr(self, r)) for r in ROLES} | {"rubric_max_weight": self.rubric_max_weight, "require_self_test": self.require_self_test}
        return json.dumps(kept, sort_keys=True, ensure_ascii=False)

    def fingerprint(self) -> str:
        """Of the rules and knobs alone."""
        return _digest("harness", self._content())

    def rules_for(self, role: str, /) -> list[str]:
        """A solver's role is weak or strong; the loop judge has the judge's rules."""
        own = {"weak": "solver", "strong": "solver", "loop_judge": "judge"}.get(role, role)
        rules = list(getattr(self, own, ()))
        if self.require_self_test and role == "challenger":
            rules.append("Put into payload.self_test one sentence on what of the source an answer depends on.")
        if self.require_self_test and role == "quality":
            rules.append("Fail a candidate whose payload.self_test doesn't name something of the source.")
        return rules

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Harness:
        d = json.loads(text)
        return Harness(**{k: tuple(v) if k in ROLES else v for k, v in d.items() if k in Harness.__dataclass_fields__})


def _digest(*parts: object, length: int = 10) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:length]


SEED = Harness(
    challenger=("Ask what only a reader of this source can answer.", "Keep the answer out of the context that you quote.", "Let a criterion test a detail of the source."),
    quality=("Fail a context that gives the answer away.", "Fail a question that general knowledge answers.", "Fail weights that aren't whole numbers from 1 to 7.", "Fail criteria that take points off."),
    judge=("Reply with one JSON object and nothing else.", "Score each criterion under its own id.", "Mark down answers that would fit any question."),
    reflector=("Name what went wrong before saying what to do.",),
    rationale="seed",
)


def mutate(parent: Harness, diff: dict, iteration: int) -> Harness:
    """A child with rules removed by place and added at the end. What isn't of the right type or in range is ignored."""
    new: dict = {}
    for role in ROLES:
        rules = list(getattr(parent, role))
        drop, add = diff.get(f"{role}_rules_remove_indices"), diff.get(f"{role}_rules_add")
        gone = {i for i in drop if isinstance(i, int)} if isinstance(drop, list) else set()
        more = [x.strip() for x in add if isinstance(x, str) and x.strip()] if isinstance(add, list) else []
        new[role] = tuple(r for i, r in enumerate(rules) if i not in gone) + tuple(more)
    top = diff.get("rubric_max_weight")
    if isinstance(top, int) and not isinstance(top, bool) and 1 <= top <= 10:
        new["rubric_max_weight"] = top
    if isinstance(diff.get("require_self_test"), bool):
        new["require_self_test"] = diff["require_self_test"]
    why = str(diff.get("rationale") or "").strip() or "none given"
    return replace(parent, **new, parent_id=parent.harness_id, iteration=iteration, rationale=why, train_score=None, val_score=None)


@dataclass
class Record:
    """A rule set of the population, with its scores so far."""

    harness: Harness
    accepted: bool
    train_score: float = 0.0
    val_scores: list[float] = field(default_factory=list)

    @property
    def val_mean(self):
        """Of all validations so far; null before the first."""
        if self.val_scores:
            return math.fsum(self.val_scores) / len(self.val_scores)
        return self.harness.val_score


def select_parent(records: list[Record], temperature: float, rng: random.Random) -> Record:
    """By softmax of the validation means of accepted records, or of all if none is."""
    pool = [r for r in records if r.accepted] or records
    scores = [r.val_mean or 0.0 for r in pool]
    t, top = max(temperature, 1e-6), max(scores)
    return pool[0] if len(pool) == 1 else rng.choices(pool, [math.exp((s - top) / t) for s in scores])[0]


def best(records: list[Record]) -> Record:
    return max((r for r in records if r.accepted), key=lambda r: (r.val_mean or 0.0, r.train_score))


__all__ = [n for n in dir() if not n.startswith("_") and n != "stable_id"]
