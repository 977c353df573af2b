from __future__ import annotations

import json
import random

import pytest

from rolloom import cli, domains
from rolloom.operators import evolve, logs
from rolloom.operators.evolve import SEED, Harness, Record
from rolloom.operators.store import RunStore
from rolloom.operators.transition import Machine
from rolloom.optimizer import Optimizer
from rolloom.providers import mock
from rolloom.providers.batch import MockBatch
from rolloom.runner import Runner
from rolloom.sources.config import Acceptance, Dispatch, Domain, Evolution, Loop, Model, RunConfig
from rolloom.streaming.stateful import StreamRunner


def config(tmp_path, model="mock/default", n=2, domain=None, **more):
    docs = tmp_path / "docs"
    docs.mkdir(exist_ok=True)
    for i in range(n):
        (docs / f"{i}.md").write_text(f"document {i} on things")
    models = {k: Model(model) for k in ("challenger", "weak_solver", "strong_solver", "judge", "orchestrator")}
    more.setdefault("loop", Loop(max_rounds=2, weak_samples=2, strong_samples=2))
    return RunConfig(domain=domain or Domain("qa_from_documents", params={"docs_path": str(docs)}), output_dir=str(tmp_path / "out"), **models, **more)


def test_run_export_and_again(spark, tmp_path, capsys):
    c = config(tmp_path, prices={"mock/*": [1.0, 1.0]})
    r = Runner(spark, c, run_id="a")
    s = r.run()
    assert (s.accepted, s.rejected, s.status) == (2, 0, "completed") and s.cost_usd > 0
    assert all(x.orphans == 0 for x in r.store.integrity().collect())
    assert r.store.scores().count() == 8 and r.store.run()["status"] == "completed" and len(r.store.trajectory().first().rounds) == 1
    calls = r.store.log("calls").count()
    assert Runner(spark, c, run_id="a").run().accepted == 2 and RunStore(spark, r.path).log("calls").count() == calls
    for fmt in ("jsonl", "parquet", "sft", "dpo", "grpo"):
        assert cli.main(["export", r.path, "--format", fmt], spark) == 0
    rows = [json.loads(x) for x in (tmp_path / "out/a/exports/dpo.jsonl").read_text().splitlines()]
    assert len(rows) == 2 and rows[0]["meta"]["record"]["run_id"] == "a" and "strong" in rows[0]["chosen"][0]["content"]
    for args in (["status", r.path], ["inspect", r.path, "--stuck"]):
        assert cli.main(args, spark) == 0
    assert "ACCEPTED" in capsys.readouterr().out
    assert cli.main(["export", str(tmp_path / "none")], spark) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["export", r.path, "--format", "csv"], spark)
    assert e.value.code == 2


def test_rejected_and_resumed(spark, tmp_path):
    c = config(tmp_path, "mock/reject", n=1)
    part = Runner(spark, c, run_id="b").run(max_supersteps=3)
    assert part.status == "running" and part.accepted + part.rejected == 0
    s = Runner(spark, c, run_id="b").run()
    assert s.rejected == 1
    rounds = {x.round_n: x for x in RunStore(spark, f"{c.output_dir}/b").rounds().collect()}
    assert set(rounds) == {1, 2} and rounds[2].evaluation.reasons[0].startswith("short_circuit")


def test_failing_provider_and_budget(spark, tmp_path):
    s = Runner(spark, config(tmp_path, "mock/failing", n=1, dispatcher=Dispatch(max_request_failures=2)), run_id="c").run()
    assert s.rejected == 1
    store = RunStore(spark, str(tmp_path / "out/c"))
    assert store.items().first().reasons[0].startswith("unrecoverable: RuntimeError")
    s = Runner(spark, config(tmp_path, budget_usd=0.0, n=1), run_id="d").run()
    assert s.status == "aborted"


def test_batches(spark, tmp_path):
    p = MockBatch(mock.handler("default"), polls=2)
    # the provider only sees messages, so that weak and strong answers can't differ: the judge accepts
    c = config(tmp_path, n=1, acceptance=Acceptance(mode="judge"), dispatcher=Dispatch(poll_interval_s=0))
    r = Runner(spark, c, run_id="e", batch_provider=p, sleep=lambda s: None)
    assert r.run().accepted == 1 and p.held == {}
    assert logs.state_counts(r.store.items()).first().state == "ACCEPTED"


def test_streaming_equals_batch(spark, tmp_path):
    c = config(tmp_path, "mock/math", domain=Domain("math_word_problems", params={"topics": [{"topic": "a"}, {"topic": "b"}]}), loop=Loop(max_rounds=2))
    d = domains.build("math_word_problems", params=c.domain.params)
    one = StreamRunner(spark, str(tmp_path / "s"), Machine(c, d))
    one.seed(d.grounding(spark), "m", d.name)
    one.step()
    one.call()
    again = StreamRunner(spark, str(tmp_path / "s"), Machine(c, d))  # goes on from the checkpoint
    again.seed(d.grounding(spark), "m", d.name)  # seeds that come twice change nothing
    assert again.run() == {"ACCEPTED": 2}
    r = Runner(spark, c, run_id="m")
    assert r.run().accepted == 2
    want = {x.item_id: json.loads(x.blob)["scores"] for x in r.store.items().collect()}
    got = {x.item_id: json.loads(x.payload)["scores"] for x in again.out("settled").collect()}
    order = lambda s: sorted(s, key=lambda x: (x["solver"], x["attempt"]))
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}


def test_stream_gives_up_on_calls_that_fail(spark, tmp_path):
    c = config(tmp_path, "mock/failing")
    d = domains.build("qa_from_documents", params=c.domain.params)
    r = StreamRunner(spark, str(tmp_path / "s"), Machine(c, d), max_failures=2)
    r.seed(spark.createDataFrame([("d1", "text", {})], "source_id string, body string, metadata map<string,string>"), "r", d.name)
    assert r.run(rounds=10) == {"REJECTED": 1}
    assert "unrecoverable" in r.out("settled").first().payload


def test_sequence_numbers_are_unique(spark):
    from pyspark.sql import functions as F

    from rolloom.operators.store import sequence

    rows = spark.range(0, 2_200_000, 1, 1).union(spark.range(0, 5, 1, 1))
    got = rows.select(sequence(F.lit(3).cast("long"), F.monotonically_increasing_id()).alias("s"), "id")
    assert got.select("s").distinct().count() == 2_200_005
    assert got.agg(F.min("s")).first()[0] > 2 << 45 and got.filter(f"s >= {4 << 45}").isEmpty()
    with pytest.raises(Exception, match="too many"):
        spark.range(1).select(sequence(F.lit(1 << 18).cast("long"), F.monotonically_increasing_id())).collect()


def test_rule_sets(spark):
    diff = {"challenger_rules_remove_indices": [0, 99, "x"], "challenger_rules_add": [" new ", "", 5], "judge_rules_add": "no list", "rubric_max_weight": 11, "require_self_test": "yes", "rationale": " why "}
    child = evolve.mutate(SEED, diff, 3)
    assert child.challenger == (*SEED.challenger[1:], "new") and child.judge == SEED.judge and child.rubric_max_weight == 7 and not child.require_self_test and child.rationale == "why" and child.parent_id == SEED.harness_id
    assert evolve.mutate(SEED, {}, 1).fingerprint() == SEED.fingerprint() and Harness.from_json(child.to_json()) == child
    assert len(evolve.mutate(SEED, {"require_self_test": True}, 1).rules_for("challenger")) == len(SEED.challenger) + 1
    low, high = Record(SEED, True, 0.1, [0.1]), Record(child, True, 0.9, [0.9])
    rng = random.Random(1)
    assert sum(evolve.select_parent([low, high], 0.05, rng) is high for _ in range(200)) > 190
    assert evolve.best([low, high, Record(SEED, False, 1.0, [1.0])]) is high
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "a")], "harness_id string, parent_id string")
    assert {r.harness_id: r.depth for r in evolve.lineage(df, "c").collect()} == {"c": 0, "b": 1, "a": 2}


def test_optimizer(spark, tmp_path):
    m = Evolution(max_iterations=1, train_size=1, val_size=1, inner_max_rounds=1, max_val_reevals=0)
    o = Optimizer(spark, config(tmp_path, "mock/metaopt", n=2, metaopt=m), rng_seed=1)
    out = o.run()
    assert out.iterations == 1 and out.population == 2 and (o.dir / "best_harness.json").exists()
    assert o.population().count() == 2
    with pytest.raises(ValueError, match="needed"):
        Optimizer(spark, config(tmp_path, n=2, metaopt=Evolution(train_size=5)))


def test_init_domain(tmp_path):
    assert cli.main(["init-domain", "my_own", "--out", str(tmp_path)]) == 0 and cli.main(["init-domain", "my_own", "--out", str(tmp_path)]) == 1
    assert domains.build(path=f"{tmp_path}/my_own.py:MyOwn").name == "my_own"


def test_newer_store(spark, tmp_path):
    (tmp_path / "new" / "_schema_version=9").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="newer"):
        RunStore(spark, str(tmp_path / "new"))
