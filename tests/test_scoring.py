from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rolloom.domains import build
from rolloom.operators import scoring
from rolloom.operators.scoring import Limits
from rolloom.operators.transition import Policy, report
from rolloom.sources.config import Acceptance, Domain, Loop, RunConfig

SCHEMA = "rnd int, solver string, attempt int, total double"


def frame(spark, weak, strong, rnd=1):
    return spark.createDataFrame([(rnd, s, k, float(t)) for s, xs in (("weak", weak), ("strong", strong)) for k, t in enumerate(xs)], SCHEMA)


def verdict(spark, weak, strong, passed=True, limits=Limits()):
    r = scoring.report(frame(spark, weak, strong), "rnd")
    return scoring.rubric_verdict(r, limits, F.lit(passed), F.array(F.lit("leak"))).first()


CASES = [
    ([0.3, 0.4], [0.8, 0.85], True, []),
    ([0.7, 0.7], [0.9, 0.93], True, ["weak_avg 0.700 > 0.65"]),
    ([0.2, 0.9], [0.9, 0.93], True, ["weak_max 0.900 > 0.75"]),
    ([0.0, 0.3], [0.8, 0.9], True, ["forbid_weak_zero: a weak score is 0.0"]),
    ([0.1, 0.2], [0.4, 0.5], True, ["strong_avg 0.450 < 0.6"]),
    ([0.3, 0.3], [0.95, 0.95], True, ["strong_avg 0.950 >= ceiling 0.95"]),
    ([0.65, 0.65], [0.85, 0.85], True, ["gap 0.200 < min 0.2"]),  # the doubles' difference is below 0.2
    ([0.3, 0.4], [0.8, 0.85], False, ["quality_failed: leak"]),
]


@pytest.mark.parametrize(("weak", "strong", "passed", "want"), CASES)
def test_rubric(spark, weak, strong, passed, want):
    got = verdict(spark, weak, strong, passed)
    assert got.reasons == want and got.accepted == (not want) and (got.rationale is None) == bool(want)


def test_empty_sides(spark):
    r = scoring.report(frame(spark, [0.5], []), "rnd").first()
    assert (r.strong_n, r.strong_avg, r.strong_std, r.gap) == (0, 0.0, 0.0, -0.5)


@pytest.mark.parametrize(("weak", "strong", "ok"), [(1, 3, True), (2, 4, False), (0, 2, False)])
def test_verifiable(spark, weak, strong, ok):
    df = frame(spark, [1] * weak + [0] * (4 - weak), [1] * strong + [0] * (4 - strong))
    got = scoring.verifiable_verdict(scoring.report(df, "rnd")).first()
    assert got.accepted == ok
    assert scoring.weak_gate(scoring.report(df, "rnd"), mode="verifiable").first().gate == (weak <= 1)


def test_sets_equal_the_single_row_model(spark):
    rng = random.Random(4)
    rounds = {k: ([rng.choice([0, 0.2, 0.35, 0.65, 0.7, 1 / 3]) for _ in range(rng.randint(0, 4))], [rng.choice([0.5, 0.6, 0.85, 0.95, 2 / 3]) for _ in range(rng.randint(0, 4))]) for k in range(200)}
    rounds = {k: v for k, v in rounds.items() if v[0] or v[1]}
    rows = [(k, s, n, float(t)) for k, v in rounds.items() for s, xs in zip(("weak", "strong"), v) for n, t in enumerate(xs)]
    got = {r.rnd: r for r in scoring.rubric_verdict(scoring.report(spark.createDataFrame(rows, SCHEMA), "rnd")).collect()}
    policy = Policy(RunConfig(domain=Domain("qa_from_documents")), build("qa_from_documents"))
    for k, (weak, strong) in rounds.items():
        scores = [{"solver": s, "attempt": n, "total": float(t)} for s, xs in (("weak", weak), ("strong", strong)) for n, t in enumerate(xs)]
        want = policy.decide(scores, {"passed": True, "failures": []})
        for name in ("weak_avg", "strong_avg", "gap", "weak_n", "strong_n", "weak_zeros", "reasons", "accepted", "rationale"):
            assert getattr(got[k], name) == want[name], (k, name)
        assert abs(got[k].weak_std - report(scores)["weak_std"]) < 1e-12


def test_judge(spark):
    rows = [(True, "fine", ""), (False, " r ", " s "), (False, " r ", None), (False, None, None)]
    got = scoring.judge_decision(spark.createDataFrame(rows, "accept boolean, reason string, suggestion string")).collect()
    assert [(r.accepted, r.feedback) for r in got] == [(True, None), (False, "s"), (False, "r"), (False, "tell weak and strong answers apart better")]


def test_weighted(spark):
    rubric = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(w).alias("weight")) for i, w in (("a", 5), ("b", 3), ("a", 1))))
    per = F.create_map(F.lit("a"), F.lit(1.0))
    assert spark.range(1).select(scoring.weighted_average(per, rubric)).first()[0] == 0.25
    none = F.array().cast("array<struct<id:string,weight:int>>")
    assert spark.range(1).select(scoring.weighted_average(per, none)).first()[0] == 0.0


@pytest.mark.parametrize("bad", [{"verifiable_strong_min_correct": 5}, {"verifiable_weak_max_correct": 4}, {"verifiable_weak_max_correct": 3}])
def test_gates_that_make_no_sense(bad):
    c = RunConfig(domain=Domain("math_word_problems"), acceptance=Acceptance(**bad), loop=Loop())
    with pytest.raises(ValueError):
        Policy(c, build("math_word_problems"))
    with pytest.raises(ValueError, match="verify"):
        Policy(RunConfig(domain=Domain("qa_from_documents"), acceptance=Acceptance(mode="verifiable")), build("qa_from_documents"))


def test_histogram(spark):
    rows = [(1, False, ["leak: x", "short"], None, None), (2, True, [], False, ["gap 0.1 < min", "weak_avg 0.9"]), (3, True, [], True, []), (4, True, [], None, None), (5, False, ["leak: y"], None, None)]
    df = spark.createDataFrame(rows, "ord int, quality_passed boolean, failures array<string>, accepted boolean, reasons array<string>")
    totals, counts, first = scoring.failure_histogram(df, 2)
    assert tuple(totals.first()) == (5, 3)
    assert {r.reason: r.n for r in counts.collect()} == {"quality:leak": 2, "quality:short": 1, "gap": 1, "weak_avg": 1}
    assert [r.ord for r in first.collect()] == [1, 2]
