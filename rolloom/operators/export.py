"""Training sets from accepted records: supervised, preference pairs and prompts for reward-based training.

`records` has a row for each accepted item: item_id, refinement_round, accepted_seq, prompt (array of role and
content), reference_output, rubric, domain, scores (array of solver, attempt, raw_response, total, correct) and
the stats. All of it is one lazy plan from scan to write.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.columns import rounded

FORMATS = ("dpo", "grpo", "sft")


@dataclass(frozen=True)
class Guards:
    """What an attempt needs to be a completion or a pair."""

    verifiable: bool = False
    completion: str = "reference"  # or best-strong
    min_margin: float = 0.3
    min_chosen: float = 0.75
    min_score: float = 0.75


def attempts(records: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """A row for each usable attempt: not blank and not truncated (item_id, refinement_round, solver, attempt).

    Rank of equal totals: weak before strong, by attempt.
    """
    out = records.select("item_id", "refinement_round", F.explode("scores").alias("s")).select("item_id", "refinement_round", "s.*").filter(F.trim("raw_response") != "")
    return out if truncated is None else out.join(truncated, ["item_id", "refinement_round", "solver", "attempt"], "left_anti")


_PLACE = lambda: F.struct(F.when(F.col("solver") == "weak", 0).otherwise(1), F.col("attempt"))


def best_strong(usable: DataFrame, guards: Guards, key: str = "item_id") -> DataFrame:
    """(key, best): of the strong attempts that are correct, or have min_score, the one of the highest total, of these the first."""
    good = F.col("correct") if guards.verifiable else F.col("total") >= guards.min_score
    pool = usable.filter((F.col("solver") == "strong") & F.coalesce(good, F.lit(False)))
    return pool.groupBy(key).agg(F.max_by(F.struct("attempt", "raw_response", "total"), F.struct("total", -F.col("attempt"))).alias("best"))


def pairs(usable: DataFrame, guards: Guards, key: str = "item_id") -> DataFrame:
    """(key, chosen, rejected): the extremes by total, whoever made them, if they differ by the margin; or the best
    correct and the worst wrong attempt. Attempts of unknown correctness are neither. Equal texts make no pair."""
    what = F.struct("solver", "attempt", "raw_response", "total")
    place = F.when(F.col("solver") == "weak", 0).otherwise(1) * 1_000_000 + F.col("attempt")
    first, last = F.struct("total", -place), F.struct(-F.col("total"), place)
    if guards.verifiable:
        yes, no = F.coalesce("correct", F.lit(False)), F.coalesce(~F.col("correct"), F.lit(False))
        out = usable.groupBy(key).agg(F.max_by(F.when(yes, what), F.when(yes, first)).alias("chosen"), F.max_by(F.when(no, what), F.when(no, last)).alias("rejected")).filter("chosen is not null and rejected is not null")
    else:
        out = usable.groupBy(key).agg(F.count("*").alias("n"), F.max_by(what, first).alias("chosen"), F.max_by(what, last).alias("rejected"))
        out = out.filter((F.col("n") >= 2) & (F.col("chosen.total") >= guards.min_chosen) & (F.col("chosen.total") - F.col("rejected.total") >= guards.min_margin)).drop("n")
    return out.filter(F.trim("chosen.raw_response") != F.trim("rejected.raw_response"))


def first_of_prompt(rows: DataFrame, *order: str, prompt: str = "prompt") -> DataFrame:
    """The first row of each prompt, in the given order, which must tell all rows apart."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(prompt).orderBy(*order))).filter("_n = 1").drop("_n")


def _said(text: Column) -> Column:
    return F.struct(F.lit("assistant").alias("role"), text.alias("content"))


def build(records: DataFrame, fmt: str, guards: Guards = Guards(), truncated: DataFrame | None = None, meta: Column | None = None) -> DataFrame:
    """Rows of the format, one for each prompt, by item_id. Guards come first, so that a row that fails them
    doesn't hide a later one with its prompt. Records without a prompt are skipped."""
    records = records.filter("prompt is not null")
    extra: list[Column] = []
    if fmt == "sft":
        text = F.col("reference_output")
        if guards.completion == "best-strong":
            records = records.join(best_strong(attempts(records, truncated), guards), "item_id", "left")
            text = F.coalesce("best.raw_response", "reference_output")
        rows = records.withColumn("_text", text).filter("_text <> ''")
        columns = [F.concat("prompt", F.array(_said(F.col("_text")))).alias("messages")]
    elif fmt == "dpo":
        rows = records.join(pairs(attempts(records, truncated), guards), "item_id")
        columns = [F.col("prompt"), F.array(_said(F.col("chosen.raw_response"))).alias("chosen"), F.array(_said(F.col("rejected.raw_response"))).alias("rejected")]
        extra = [F.col(f"{s}.{c}").alias(f"{s}_{n}") for c, n in (("total", "score"), ("solver", "solver")) for s in ("chosen", "rejected")]
    elif fmt == "grpo":
        rows = records
        totals = lambda side: F.transform(F.filter("scores", lambda s: s.solver == side), lambda s: s.total)
        stats = F.struct(*(c for side in ("weak", "strong") for c in (F.col(f"{side}_avg"), rounded(deviation(totals(side)), 4).alias(f"{side}_std"))), F.col("gap"))
        kept = [F.col("reference_output").alias("solution")] if guards.verifiable else [F.col("rubric"), F.col("reference_output")]
        columns = [F.col("prompt"), F.col("domain").alias("task"), F.lit("verifiable" if guards.verifiable else "rubric_judge").alias("reward_kind"), *kept, stats.alias("stats")]
    else:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    rows = first_of_prompt(rows, "accepted_seq", "item_id")
    if meta is not None:
        columns.append(F.struct(meta.alias("record"), *extra).alias("meta") if extra else F.struct(meta.alias("record")).alias("meta"))
    return rows.select("item_id", *columns).orderBy("item_id")


def deviation(xs: Column) -> Column:
    """Population standard deviation of an array; 0.0 of none."""
    n = F.size(xs).cast("double")
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 0, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)).otherwise(0.0)


def record_meta(*columns: str) -> Column:
    return F.struct(*columns)


def write(rows: DataFrame, target: str | Path, to: str = "jsonl", card: str | None = None) -> int:
    """Rows as one JSON-lines file, with a card beside, or as Parquet in the directory's data, with the card in it; returns
    their number.

    A Parquet export of no rows is an error. The one file is streamed through the driver partition by partition.
    """
    target = Path(target)
    rows = rows.drop("item_id")
    if to == "parquet":
        n = rows.count()
        if not n:
            raise RuntimeError("no rows to export")
        rows.write.mode("overwrite").parquet(str(target / "data"))
        if card:
            (target / "README.md").write_text(card, encoding="utf-8")
        return n
    n, lines = 0, rows.select(F.to_json(F.struct("*")).alias("j"))
    target.parent.mkdir(exist_ok=True, parents=True)
    with open(target, mode="w", encoding="utf-8") as out:
        for n, r in enumerate(lines.toLocalIterator(), 1):  # noqa: B007
            print(r["j"], file=out)
    if card:
        target.with_suffix(".README.md").write_text(card, encoding="utf-8")
    return n


_ABOUT = {
    "sft": "Each row is a conversation that ends with the answer to learn. Apply a chat template before tokenising.",
    "dpo": "Each row is a prompt with a preferred and a rejected answer: the extremes of all attempts by score, whichever solver made them, if they lie far enough apart.",
    "grpo": "Each row is a prompt with what a reward function needs.",
}
_REWARD = '''
A reward from the rubric, where score(text, criterion, reference) gives 0 to 1:

```python
def reward(completions, rubric, reference_output, **_):
    out = []
    for text, criteria, reference in zip(completions, rubric, reference_output):
        weights = [c["weight"] for c in criteria]
        marks = [score(text, c, reference) for c in criteria]
        out.append(sum(w * m for w, m in zip(weights, marks)) / max(sum(weights), 1))
    return out
```
'''


def card(fmt: str, run_id: str, rows: int, domain: str, verifiable: bool) -> str:
    body = _ABOUT[fmt] + ("" if fmt != "grpo" else "\n\nThe column solution has the right answer." if verifiable else "\n" + _REWARD)
    return f"# {fmt} set\n\nRun {run_id}, {rows} rows, domain {domain}, {'checked' if verifiable else 'judged'} attempts.\n\n{body}\n"
