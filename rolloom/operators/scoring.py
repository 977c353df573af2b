"""Score statistics of rounds and the verdicts over them, as grouped aggregations and Columns.

`scores` has a row for each attempt: the key columns, solver ('weak' or 'strong'), attempt, total in [0, 1], and
where they are used raw_response, per_criterion, correct.
"""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.columns import exact_mean, fixed, reasons, rounded


@dataclass(frozen=True)
class Limits:
    """Acceptance thresholds. An average at strong_avg_max is already too high; all others may be met exactly."""

    min_gap: float = 0.2
    strong_avg_max: float = 0.95
    weak_avg_max: float = 0.65
    require_quality_passed: bool = True
    strong_avg_min: float = 0.6
    verifiable_strong_min_correct: int = 3
    weak_max_max: float = 0.75
    rubric_max_weight: int = 7
    verifiable_weak_max_correct: int = 1
    forbid_weak_zero: bool = True


def report(scores: DataFrame, *keys: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Per key: n, mean, max, min, population deviation and zeros of each side, correct attempts and the gap.

    A side without attempts counts as one attempt of 0.0. The gap is the difference of the rounded means.
    extra: other aggregates of the same rows.
    """
    out = list(extra)
    for side in ("weak", "strong"):
        mine = F.col("solver") == side
        total = F.when(mine, F.col("total"))
        out += [
            F.count(total).alias(f"{side}_n"),
            exact_mean("total", mine).alias(f"{side}_avg"),
            F.coalesce(F.max(total), F.lit(0.0)).alias(f"{side}_max"),
            F.coalesce(F.min(total), F.lit(0.0)).alias(f"{side}_min"),
            F.coalesce(F.stddev_pop(total), F.lit(0.0)).alias(f"{side}_std"),
            F.count_if(total == 0.0).alias(f"{side}_zeros"),
            F.count_if(total >= 1.0).alias(f"{side}_correct"),
        ]
    return scores.groupBy(*keys).agg(*out).withColumn("gap", F.col("strong_avg") - F.col("weak_avg"))


def weak_reasons(limits: Limits) -> list[tuple[Column, Column]]:
    say = lambda name, most: F.concat(F.lit(f"{name} "), fixed(name), F.lit(f" > {most}"))
    return [
        (F.col("weak_avg") > limits.weak_avg_max, say("weak_avg", limits.weak_avg_max)),
        (F.col("weak_max") > limits.weak_max_max, say("weak_max", limits.weak_max_max)),
        (F.lit(limits.forbid_weak_zero) & (F.col("weak_zeros") > 0), F.lit("forbid_weak_zero: a weak score is 0.0")),
    ]


def _quality(passed: Column | None, failures: Column | None, limits: Limits) -> list[tuple[Column, Column]]:
    if passed is None or not limits.require_quality_passed:
        return []
    text = F.coalesce(F.nullif(F.array_join(failures, ", "), F.lit("")), F.lit("unspecified")) if failures is not None else F.lit("unspecified")
    return [(~F.coalesce(passed, F.lit(False)), F.concat(F.lit("quality_failed: "), text))]


def rubric_verdict(reports: DataFrame, limits: Limits = Limits(), passed: Column | None = None, failures: Column | None = None) -> DataFrame:
    """reports with reasons, accepted and rationale (null unless accepted), by thresholds and the gap."""
    why = reasons(
        *_quality(passed, failures, limits),
        *weak_reasons(limits),
        (F.col("strong_avg") < limits.strong_avg_min, F.concat(F.lit("strong_avg "), fixed("strong_avg"), F.lit(f" < {limits.strong_avg_min}"))),
        (F.col("strong_avg") >= limits.strong_avg_max, F.concat(F.lit("strong_avg "), fixed("strong_avg"), F.lit(f" >= ceiling {limits.strong_avg_max}"))),
        (F.col("gap") < limits.min_gap, F.concat(F.lit("gap "), fixed("gap"), F.lit(f" < min {limits.min_gap}"))),
    )
    text = F.concat(F.lit("weak "), fixed("weak_avg"), F.lit(", strong "), fixed("strong_avg"), F.lit(", gap "), fixed("gap"))
    return _verdict(reports, why, text)


def verifiable_verdict(reports: DataFrame, limits: Limits = Limits(), passed: Column | None = None, failures: Column | None = None) -> DataFrame:
    """As rubric_verdict, by counts of correct attempts."""
    weak, strong = limits.verifiable_weak_max_correct, limits.verifiable_strong_min_correct
    why = reasons(
        *_quality(passed, failures, limits),
        (F.col("weak_correct") > weak, F.concat(F.lit("weak_correct "), F.col("weak_correct").cast("string"), F.lit(f" > {weak} (too easy)"))),
        (F.col("strong_correct") < strong, F.concat(F.lit("strong_correct "), F.col("strong_correct").cast("string"), F.lit(f" < {strong} (too hard)"))),
    )
    of = lambda side: F.concat_ws("/", F.col(f"{side}_correct").cast("string"), F.col(f"{side}_n").cast("string"))
    return _verdict(reports, why, F.concat(F.lit("weak "), of("weak"), F.lit(", strong "), of("strong")))


def _verdict(reports: DataFrame, why: Column, text: Column) -> DataFrame:
    out = reports.withColumn("reasons", why).withColumn("accepted", F.size("reasons") == 0)
    return out.withColumn("rationale", F.when(F.col("accepted"), text))


def weak_gate(reports: DataFrame, limits: Limits = Limits(), mode: str = "rubric") -> DataFrame:
    """reports with gate: may the strong solver run? The judge's mode always lets it."""
    if mode == "judge":
        return reports.withColumn("gate", F.lit(True))
    if mode == "verifiable":
        return reports.withColumn("gate", F.col("weak_correct") <= limits.verifiable_weak_max_correct)
    return reports.withColumn("gate", F.size(reasons(*weak_reasons(limits))) == 0)


def short_circuit(reports: DataFrame, limits: Limits = Limits(), mode: str = "rubric") -> DataFrame:
    """Rounds whose weak gate failed, as rejected with the strong side empty."""
    out = weak_gate(reports, limits, mode).filter("not gate").drop("gate")
    for c in ("avg", "max", "min", "std"):
        out = out.withColumn(f"strong_{c}", F.lit(0.0))
    return out.withColumns({"gap": 0.0 - F.col("weak_avg"), "accepted": F.lit(False), "reasons": F.array(F.lit("short_circuit: weak gate failed (too easy)"))})


def judge_decision(verdicts: DataFrame) -> DataFrame:
    """verdicts (accept, reason, suggestion) with accepted, reasons and feedback: the suggestion, else the reason, else a stock phrase."""
    said = F.nullif(F.trim(F.coalesce("reason", F.lit(""))), F.lit(""))
    feedback = F.coalesce(F.nullif(F.trim(F.coalesce("suggestion", F.lit(""))), F.lit("")), said, F.lit("tell weak and strong answers apart better"))
    accepted = F.coalesce("accept", F.lit(False))
    return verdicts.withColumns(
        {
            "accepted": accepted,
            "reasons": F.when(accepted, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(": ", F.lit("judge wants better"), F.nullif("reason", F.lit(""))))),
            "feedback": F.when(~accepted, feedback),
        }
    )


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    """For prompts: the attempts' totals by attempt, means, deviations and the gap, to three decimals."""
    mine = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("solver") == side, F.struct("attempt", "total")))), lambda x: rounded(x.total))
    both = report(scores, *keys, extra=[mine("weak").alias("weak_totals"), mine("strong").alias("strong_totals")])
    return both.select(*keys, "weak_totals", "strong_totals", *(rounded(c).alias(c) for c in ("weak_avg", "weak_std", "strong_avg", "strong_std", "gap")))


def weighted_average(per_criterion: Column, rubric: Column) -> Column:
    """Of the criteria's values by weight, missing ones 0, within [0, 1]; of equal ids the last weight counts; no weight: 0."""
    ids = F.array_distinct(F.transform(rubric, lambda c: c.id))
    weight_of = lambda i: F.element_at(F.filter(rubric, lambda c: c.id == i), -1).weight
    top = F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(per_criterion, i), F.lit(0.0)) * weight_of(i))
    all_ = F.aggregate(ids, F.lit(0.0), lambda a, i: a + weight_of(i))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / F.when(all_ == 0, 1.0).otherwise(all_)))


def truncated(attempts: DataFrame) -> DataFrame:
    """Attempts that used up their tokens; unknown use or limit: not truncated."""
    return attempts.filter(F.col("completion_tokens") >= F.col("max_tokens"))


def untruncated(attempts: DataFrame) -> DataFrame:
    """The other attempts."""
    return attempts.filter(~F.coalesce(F.col("completion_tokens") >= F.col("max_tokens"), F.lit(False)))


def buckets(rounds: DataFrame, weak_ceiling: float, strong_floor: float) -> DataFrame:
    """rounds (quality_passed and a report's columns) by why they failed. The first two may both hold; a round
    without strong attempts isn't one that strong failed."""
    scored = F.coalesce("quality_passed", F.lit(False))
    return rounds.select(
        *rounds.columns,
        (~scored).alias("failed_quality"),
        (scored & F.coalesce(F.col("weak_avg") > weak_ceiling, F.lit(False))).alias("too_easy"),
        (scored & F.coalesce((F.col("strong_n") > 0) & (F.col("strong_avg") < strong_floor), F.lit(False))).alias("failed_strong"),
    )


def completed(reports: DataFrame, weak_samples: int, strong_samples: int) -> DataFrame:
    """reports with weak_done and all_done."""
    weak = F.col("weak_n") >= weak_samples
    return reports.withColumns({"weak_done": weak, "all_done": weak & (F.col("strong_n") >= strong_samples)})


def failure_histogram(rounds: DataFrame, samples: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, counts by reason, first samples) of rounds (ord, quality_passed, failures, accepted, reasons).

    A failed quality check counts by its failures up to the colon, under quality:, else a rejection by the first
    word of each reason. A round with neither verdict is only in the total.
    """
    failed = ~F.coalesce("quality_passed", F.lit(True))
    rejected = ~failed & ~F.coalesce("accepted", F.lit(True))
    totals = rounds.agg(F.count("*").alias("total_rounds"), F.count_if(failed | rejected).alias("rejected_rounds"))
    keys = F.when(failed, F.transform("failures", lambda f: F.concat(F.lit("quality:"), F.split_part(f, F.lit(":"), F.lit(1))))).when(rejected, F.transform("reasons", lambda r: F.split_part(r, F.lit(" "), F.lit(1))))
    counts = rounds.select(F.explode(keys).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    text = F.when(failed, F.lit("quality_failed")).otherwise(F.array_join("reasons", "; "))
    first = rounds.filter(failed | rejected).select("ord", text.alias("reason"), "failures").orderBy("ord").limit(samples)
    return totals, counts, first
