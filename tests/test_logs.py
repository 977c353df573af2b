from __future__ import annotations

from rolloom.operators import logs


def test_fold_and_latest(spark):
    e = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 3, "y", None), ("b", 1, None, None)], "k string, seq int, t string, n int")
    assert {r.k: (r.t, r.n) for r in logs.fold(e, ["k"], "seq", "t", "n").collect()} == {"a": ("y", 5), "b": (None, None)}
    assert {r.k: (r.t, r.n) for r in logs.latest(e, ["k"], "seq").collect()} == {"a": ("y", None), "b": (None, None)}


def test_insert_if_absent(spark):
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x")], "k string, seq int, v string")
    have = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in logs.insert_if_absent(new, have, ["k"], "seq").collect()] == [("a", 1, "first")]


def test_ready(spark):
    items = spark.createDataFrame([("a", "NEED_SCORES", 5), ("b", "NEED_SCORES", None), ("c", "ACCEPTED", 0), ("d", "NEED_SCORES", 9)], "item_id string, state string, consumed_seq long")
    responses = spark.createDataFrame([("a", 5), ("a", 6), ("b", 0), ("c", 9), ("d", 9)], "item_id string, seq long")
    assert sorted(r.item_id for r in logs.ready(items, responses).collect()) == ["a", "b"]


def test_hydrate(spark):
    rq = spark.createDataFrame([("s", "i", 1, "weak", 0, None), ("j", "i", 1, "judge", 0, "s"), ("q", "i", 1, "quality", 0, "s")], "request_id string, item_id string, round_n int, role string, attempt int, parent_response_id string")
    rs = spark.createDataFrame([("s", "i", "answer", 1), ("j", "i", "score", 2), ("q", "i", "fine", 3)], "request_id string, item_id string, text string, seq long")
    got = {r.request_id: (r.solver_role, r.solver_text) for r in logs.hydrate(rs, rq).collect()}
    assert got == {"s": (None, None), "j": ("weak", "answer"), "q": (None, None)}


def test_failures_resume_and_dead_letters(spark):
    rq = spark.createDataFrame([("a", "i", "pending"), ("b", "i", "pending"), ("c", "k", "pending")], "request_id string, item_id string, status string")
    bad = spark.createDataFrame([("a", "e1", 1), ("a", "e2", 2), ("b", "z", 1)], "request_id string, error string, seq long")
    after = logs.after_failures(rq, bad, 2)
    assert {r.request_id: (r.status, r.failure_count, r.last_error) for r in after.collect()} == {"a": ("failed", 2, "e2"), "b": ("pending", 1, "z"), "c": ("pending", 0, None)}
    items = spark.createDataFrame([("i", "NEED_SCORES"), ("k", "REJECTED")], "item_id string, state string")
    assert [tuple(r) for r in logs.unrecoverable(items, after, 2).collect()] == [("i", "e2")]
    rows = [("l", "in_flight", None, 0), ("m", "in_flight", "b", 0), ("n", "done", None, 0), ("o", "done", None, 0), ("p", "failed", None, 2), ("q", "failed", None, 3)]
    states = spark.createDataFrame(rows, "request_id string, status string, batch_id string, failure_count int")
    got = {r.request_id: (r.status, r.why) for r in logs.resumed(states, spark.createDataFrame([("o",)], "request_id string"), 3).collect()}
    assert got == {"l": ("pending", "lost"), "m": ("in_flight", None), "n": ("pending", "unanswered"), "o": ("done", None), "p": ("pending", "retry"), "q": ("failed", None)}


def test_reconcile(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    r = spark.createDataFrame([("a", None), ("b", "bad"), ("z", None)], "request_id string, error string")
    assert {x.request_id: x.outcome for x in logs.reconcile(t, r).collect()} == {"a": "done", "b": "failed", "c": "missing", "z": "unknown"}


def test_costs_and_budget(spark):
    r = spark.createDataFrame([("a", 1.0, 1), ("a", 9.0, 2), ("b", None, 3), ("c", 3.0, 4)], "request_id string, cost_usd double, seq long").selectExpr("'r' as run", "*")
    assert logs.costs(r, "run").first().cost_usd == 4.0
    t = logs.budget_trip(r, 12.0, "run").first()
    assert (t.warned_at, t.stopped_at) == (2, 4)


def test_integrity(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,)], "y int")
    assert logs.integrity({"a": a, "b": b}, [("a", "x", "b", "y")]).first().orphans == 1
