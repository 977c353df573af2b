from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rolloom.operators import export
from rolloom.operators.export import Guards

SCORE = "struct<solver:string,attempt:int,raw_response:string,total:double,correct:boolean>"
SCHEMA = f"item_id string, refinement_round int, accepted_seq long, prompt array<struct<role:string,content:string>>, reference_output string, rubric array<struct<id:string,weight:int>>, domain string, scores array<{SCORE}>, weak_avg double, strong_avg double, gap double"


def record(item, prompt="p", scores=(), reference="ref", seq=1):
    return (item, 1, seq, [("user", prompt)] if prompt else None, reference, [("c1", 5)], "qa", list(scores), 0.2, 0.8, 0.6)


def s(solver, attempt, total, text=None, correct=None):
    return (solver, attempt, f"{solver}{attempt}" if text is None else text, total, correct)


def rows(spark, records, fmt, truncated=None, meta=None, **guards):
    df = spark.createDataFrame(records, SCHEMA)
    t = None if truncated is None else spark.createDataFrame(truncated, "item_id string, refinement_round int, solver string, attempt int")
    return export.build(df, fmt, Guards(**guards), t, meta).collect()


GOOD = [s("weak", 0, 0.2), s("weak", 1, 0.3), s("strong", 0, 0.8), s("strong", 1, 0.9)]


def test_sft(spark):
    got = rows(spark, [record("b", "q"), record("a", "p", GOOD), record("c", None), record("d", "r", reference="")], "sft")
    assert [r.item_id for r in got] == ["a", "b"] and got[0].messages[-1].content == "ref"
    got = rows(spark, [record("a", "p", GOOD), record("b", "q")], "sft", completion="best-strong")
    assert [r.messages[-1].content for r in got] == ["strong1", "ref"]
    got = rows(spark, [record("a", "p", GOOD)], "sft", [("a", 1, "strong", 1)], completion="best-strong")
    assert got[0].messages[-1].content == "strong0"


def test_best_strong_ties(spark):
    df = spark.createDataFrame([record("a", "p", [s("strong", 1, 0.9), s("strong", 0, 0.9), s("strong", 2, 0.95, " ")])], SCHEMA)
    assert export.best_strong(export.attempts(df), Guards()).first().best.attempt == 0


def test_dpo(spark):
    r = rows(spark, [record("a", "p", GOOD)], "dpo")[0]
    assert (r.chosen[0].content, r.rejected[0].content) == ("strong1", "weak0")
    upside_down = [s("weak", 0, 0.9), s("strong", 0, 0.3)]
    assert rows(spark, [record("a", "p", upside_down)], "dpo")[0].chosen[0].content == "weak0"
    for bad in ([s("weak", 0, 0.2)], [s("weak", 0, 0.6), s("strong", 0, 0.8)], [s("weak", 0, 0.1), s("strong", 0, 0.7)], [s("weak", 0, 0.1, "x"), s("strong", 0, 0.9, " x ")], [s("weak", 0, 0.1, " "), s("strong", 0, 0.9)]):
        assert rows(spark, [record("a", "p", bad)], "dpo") == []
    assert rows(spark, [record("a", "p", GOOD)], "dpo", [("a", 1, "strong", 1), ("a", 1, "strong", 0)]) == []


def test_dpo_verifiable(spark):
    mixed = [s("weak", 0, 0.0, "bad", False), s("weak", 1, 0.0, "odd"), s("strong", 0, 1.0, "good", True)]
    r = rows(spark, [record("a", "p", mixed)], "dpo", verifiable=True)[0]
    assert (r.chosen[0].content, r.rejected[0].content) == ("good", "bad")
    assert rows(spark, [record("a", "p", mixed[1:])], "dpo", verifiable=True) == []


def test_guards_come_before_dedup(spark):
    got = rows(spark, [record("a", "p", GOOD[:1], seq=1), record("b", "p", GOOD, seq=2), record("c", "p", GOOD, seq=3)], "dpo")
    assert [r.item_id for r in got] == ["b"]


def test_grpo(spark):
    r = rows(spark, [record("a", "p", [s("weak", 0, 0.2), s("weak", 1, 0.3)])], "grpo", meta=F.struct("item_id"))[0]
    assert r.reward_kind == "rubric_judge" and r.rubric[0].id == "c1" and r.stats.weak_std == 0.05 and r.stats.strong_std == 0.0 and r.meta.record.item_id == "a"
    r = rows(spark, [record("a", "p")], "grpo", verifiable=True)[0]
    assert r.solution == "ref" and "rubric" not in r.asDict()


def test_write(spark, tmp_path):
    df = export.build(spark.createDataFrame([record("b", "q"), record("a", "p")], SCHEMA), "sft")
    assert export.write(df, tmp_path / "x.jsonl", card="# card") == 2
    lines = (tmp_path / "x.jsonl").read_text().splitlines()
    assert [json.loads(x)["messages"][0]["content"] for x in lines] == ["p", "q"] and (tmp_path / "x.README.md").exists()
    assert export.write(df, tmp_path / "pq", "parquet", "# card") == 2 and spark.read.parquet(str(tmp_path / "pq" / "data")).count() == 2
    with pytest.raises(RuntimeError, match="no rows"):
        export.write(df.limit(0), tmp_path / "none", "parquet")
    with pytest.raises(ValueError, match="format"):
        export.build(df, "csv")
    for fmt in export.FORMATS:
        assert fmt in export.card(fmt, "r", 1, "qa", False) and export.card(fmt, "r", 1, "qa", True)
