"""The catalogue of queries over the driver's tables, and the SQL that each is held against.

lineitem stands for solver attempts, events for responses, orders for items and requests, conversations for
messages, documents for grounding. See README for the views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloom.functions import columns as C
from rolloom.operators import export, logs, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- views

ATTEMPT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """(rnd, solver, attempt, pts, total, tokens, max_tokens, raw_response, correct): the attempts of each round."""
    li = table(spark, d, "lineitem")
    step = F.round(F.col("l_discount") * 100).cast("long")
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy(*ATTEMPT_ORDER)) - 1
    pts = F.when(F.col("l_linestatus") == "F", step * 7).otherwise(30 + step * 7)
    out = li.select(
        F.col("l_orderkey").alias("rnd"), F.when(F.col("l_linestatus") == "F", "weak").otherwise("strong").alias("solver"), n.alias("attempt"), pts.alias("pts"),
        F.col("l_quantity").cast("long").alias("completion_tokens"), F.when(F.col("l_tax") > 0.05, 40).otherwise(60).cast("long").alias("max_tokens"),
        F.concat_ws("-", F.lit("r"), F.col("l_partkey").cast("string")).alias("raw_response"), F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("correct"),
    )
    return out.withColumn("total", F.col("pts") / 100.0)


ATTEMPTS_SQL = """a AS (SELECT l_orderkey AS rnd, CASE WHEN l_linestatus = 'F' THEN 'weak' ELSE 'strong' END AS solver,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS attempt,
  CAST(round(l_discount * 100) AS BIGINT) * 7 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 30 END AS pts,
  CAST(l_quantity AS BIGINT) AS completion_tokens, CASE WHEN l_tax > 0.05 THEN 40 ELSE 60 END AS max_tokens,
  'r-' || l_partkey AS raw_response, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS correct FROM lineitem)"""
REPORT_SQL = ATTEMPTS_SQL + """,
g AS (SELECT rnd, count(*) FILTER (solver = 'weak') AS weak_n, count(*) FILTER (solver = 'strong') AS strong_n,
  coalesce(CAST(sum(pts) FILTER (solver = 'weak') AS DOUBLE) / (100 * nullif(count(*) FILTER (solver = 'weak'), 0)), 0.0) AS weak_avg,
  coalesce(CAST(sum(pts) FILTER (solver = 'strong') AS DOUBLE) / (100 * nullif(count(*) FILTER (solver = 'strong'), 0)), 0.0) AS strong_avg,
  coalesce(max(pts) FILTER (solver = 'weak') / 100.0, 0.0) AS weak_max, coalesce(max(pts) FILTER (solver = 'strong') / 100.0, 0.0) AS strong_max,
  coalesce(min(pts) FILTER (solver = 'weak') / 100.0, 0.0) AS weak_min, coalesce(min(pts) FILTER (solver = 'strong') / 100.0, 0.0) AS strong_min,
  coalesce(stddev_pop(pts / 100.0) FILTER (solver = 'weak'), 0.0) AS weak_std, coalesce(stddev_pop(pts / 100.0) FILTER (solver = 'strong'), 0.0) AS strong_std,
  count(*) FILTER (solver = 'weak' AND pts = 0) AS weak_zeros, count(*) FILTER (solver = 'weak' AND pts >= 100) AS weak_correct,
  count(*) FILTER (solver = 'strong' AND pts >= 100) AS strong_correct FROM a GROUP BY rnd),
p AS (SELECT *, strong_avg - weak_avg AS gap FROM g)"""

RESPONSES_SQL = """e AS (SELECT event_id AS seq, user_id AS item_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(seq, item_id, event_type, value, k): the responses of each item."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), "event_type", "value", k.alias("k"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, state, consumed_seq): items of the responses; each third is settled, and half the responses are consumed."""
    e = responses(spark, d)
    state = F.when(F.col("item_id") % 3 == 0, "ACCEPTED").otherwise("NEED_SCORES")
    return e.groupBy("item_id").agg(F.max("seq").alias("last"), F.min("seq").alias("first")).select("item_id", state.alias("state"), (F.col("last") - F.col("item_id") % 20).alias("consumed_seq"), F.col("first").alias("updated_at"))


ITEMS_SQL = RESPONSES_SQL + """,
i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'ACCEPTED' ELSE 'NEED_SCORES' END AS state, max(seq) - item_id % 20 AS consumed_seq, min(seq) AS updated_at FROM e GROUP BY item_id)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, item_id, seq, status, batch_id, failure_count): orders as requests of customers."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in_flight").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("pending"))
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("batch_id"), (F.col("o_orderkey") % 4).alias("failure_count"))


REQUESTS_SQL = """q AS (SELECT o_orderkey AS request_id, o_custkey AS item_id, o_orderkey AS seq,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_flight' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'pending' END END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS batch_id, o_orderkey % 4 AS failure_count FROM orders)"""


# ---------------------------------------------------------------- sources and sinks


@query("""SELECT substr(sha256(concat_ws('|', 'doc', doc_id)), 1, 12) AS source_id, substr(text, 1, 12000) AS body, source FROM documents WHERE length(trim(text)) > 0""")
def q_grounding_scan(spark, d):
    from rolloom.sources.grounding import from_table

    return from_table(table(spark, d, "documents"), "doc_id", "text").select("source_id", "body", F.col("metadata.source").alias("source"))


@query("""SELECT doc_id, substr(sha256(concat_ws('|', 'run', doc_id)), 1, 12) AS item_id, 'PENDING' AS state FROM documents
WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100""")
def q_seed_items(spark, d):
    docs = table(spark, d, "documents").filter(F.col("lang").isin("en", "de")).select("doc_id")
    fresh = logs.insert_if_absent(docs, table(spark, d, "labels"), ["doc_id"]).orderBy("doc_id").limit(100)
    return fresh.select("doc_id", C.stable_id("run", F.col("doc_id")).alias("item_id"), F.lit("PENDING").alias("state"))


@query("""SELECT doc_id, substr(sha256(concat_ws('|', 'math', coalesce(lang, 'None'), coalesce(source, '?'))), 1, 12) AS topic_id,
 substr(sha256(concat_ws('|', doc_id, n_chars)), 1, 10) AS short_id FROM documents""")
def q_stable_id(spark, d):
    return table(spark, d, "documents").select("doc_id", C.stable_id("math", F.col("lang"), F.coalesce("source", F.lit("?"))).alias("topic_id"), C.stable_id(F.col("doc_id"), F.col("n_chars"), length=10).alias("short_id"))


@query(f"""WITH {RESPONSES_SQL} SELECT seq, k, k IS NOT NULL AS ok FROM e""")
def q_json_props(spark, d):
    got = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), got.alias("k"), got.isNotNull().alias("ok"))


@query("""SELECT o_orderkey, '{"custom_id":"r-' || o_orderkey || '","method":"POST","url":"/v1/chat/completions","body":{"model":"' || o_orderpriority || '","messages":[{"role":"user","content":"' || o_custkey || '"}]'
 || CASE WHEN o_orderkey % 2 = 0 THEN ',"max_tokens":' || o_custkey ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ',"response_format":{"type":"json_object"}' ELSE '' END || '}}' AS line FROM orders""")
def q_batch_lines(spark, d):
    from rolloom.providers.batch import line

    o = table(spark, d, "orders")
    r = o.select("o_orderkey", F.concat(F.lit("r-"), F.col("o_orderkey").cast("string")).alias("request_id"), F.col("o_orderpriority").alias("model_key"), F.array(F.struct(F.lit("user").alias("role"), F.col("o_custkey").cast("string").alias("content"))).alias("messages"), F.lit(None).cast("double").alias("temperature"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("int")).alias("max_tokens"), (F.col("o_orderkey") % 3 == 0).alias("json_mode"))
    return r.select("o_orderkey", line().alias("line"))


# ---------------------------------------------------------------- items, requests, responses


@query("""SELECT o_custkey AS run, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL""")
def q_state_counts(spark, d):
    return logs.state_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("state")), "run")


@query(f"""WITH {ITEMS_SQL} SELECT item_id, state FROM i WHERE state NOT IN ('ACCEPTED', 'REJECTED')""")
def q_stuck_items(spark, d):
    return logs.stuck(items(spark, d).withColumns({"source_id": F.lit(""), "current_round": F.lit(0)})).select("item_id", "state")


@query(f"""WITH {ITEMS_SQL} SELECT item_id, consumed_seq FROM i WHERE state NOT IN ('ACCEPTED', 'REJECTED')
 AND EXISTS (SELECT 1 FROM e WHERE e.item_id = i.item_id AND e.seq > i.consumed_seq) ORDER BY updated_at, item_id LIMIT 100""")
def q_ready_items(spark, d):
    return logs.ready(items(spark, d), responses(spark, d)).orderBy("updated_at", "item_id").limit(100).select("item_id", "consumed_seq")


@query(f"""WITH {RESPONSES_SQL}, h AS (SELECT seq AS request_id, item_id, k % 3 AS round_n, CASE event_type WHEN 'error' THEN 'judge' WHEN 'click' THEN 'weak' WHEN 'view' THEN 'strong' ELSE event_type END AS role,
 k AS attempt, CASE WHEN event_type = 'error' THEN seq - 1 - k % 7 END AS parent_response_id, value FROM e)
SELECT h.request_id, h.role, h.parent_response_id, CASE WHEN h.role = 'judge' AND h.parent_response_id IS NOT NULL THEN p.role END AS solver_role,
 CASE WHEN h.role = 'judge' AND h.parent_response_id IS NOT NULL THEN CAST(round(t.value * 100) AS BIGINT) END AS solver_cents FROM h LEFT JOIN h p ON h.parent_response_id = p.request_id LEFT JOIN h t ON h.parent_response_id = t.request_id""")
def q_hydrate(spark, d):
    e = responses(spark, d)
    role = F.when(F.col("event_type") == "error", "judge").when(F.col("event_type") == "click", "weak").when(F.col("event_type") == "view", "strong").otherwise(F.col("event_type"))
    parent = F.when(F.col("event_type") == "error", F.col("seq") - 1 - F.col("k") % 7)
    rq = e.select(F.col("seq").alias("request_id"), "item_id", (F.col("k") % 3).alias("round_n"), role.alias("role"), F.col("k").alias("attempt"), parent.alias("parent_response_id"))
    rs = e.select(F.col("seq").alias("request_id"), F.round(F.col("value") * 100).cast("long").alias("text"))
    return logs.hydrate(rs, rq).select("request_id", "role", "parent_response_id", "solver_role", F.col("solver_text").alias("solver_cents"))


@query(f"""WITH {RESPONSES_SQL} SELECT item_id, event_type AS role, min(seq) AS request_id, max(seq) AS consumed_seq, arg_min(k, seq) AS k FROM e GROUP BY ALL""")
def q_first_of_role(spark, d):
    return logs.first_by_role(responses(spark, d).withColumnRenamed("event_type", "role"), "k", "item_id")


@query(f"""WITH {REQUESTS_SQL} SELECT request_id, 'in_flight' AS status FROM q WHERE status = 'pending' ORDER BY seq LIMIT 25""")
def q_claim_fifo(spark, d):
    return logs.claim(requests(spark, d), 25).select("request_id", F.lit("in_flight").alias("status"))


@query(f"""WITH {REQUESTS_SQL} SELECT c_nationkey AS run_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_flight') AS in_flight
 FROM q JOIN customer ON item_id = c_custkey GROUP BY c_nationkey""")
def q_pending_counts(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("run_id"))
    return logs.pending_counts(requests(spark, d), runs)


@query(f"""WITH {RESPONSES_SQL}, f AS (SELECT item_id AS request_id, count(*) AS failure_count, arg_max(CAST(k AS VARCHAR), seq) AS last_error FROM e WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT DISTINCT item_id AS request_id FROM e)
SELECT request_id, coalesce(failure_count, 0) AS failure_count, last_error, CASE WHEN failure_count >= 13 THEN 'failed' ELSE 'pending' END AS status FROM r LEFT JOIN f USING (request_id)""")
def q_fail_cap(spark, d):
    e = responses(spark, d)
    rq = e.select(F.col("item_id").alias("request_id")).distinct().withColumn("status", F.lit("pending"))
    bad = e.filter("event_type = 'error'").select(F.col("item_id").alias("request_id"), F.col("k").cast("string").alias("error"), "seq")
    return logs.after_failures(rq, bad, 13)


@query(f"""WITH {ITEMS_SQL} SELECT i.item_id, max('e' || k) AS error FROM i JOIN e USING (item_id) WHERE state NOT IN ('ACCEPTED', 'REJECTED') AND event_type = 'error' AND k >= 50 GROUP BY i.item_id""")
def q_unrecoverable(spark, d):
    rq = responses(spark, d).select("item_id", F.when(F.col("event_type") == "error", "failed").alias("status"), F.col("k").alias("failure_count"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("last_error"))
    return logs.unrecoverable(items(spark, d), rq, 50)


@query(f"""WITH {REQUESTS_SQL}, r AS (SELECT *, CASE WHEN status = 'in_flight' AND batch_id IS NULL THEN 'lost'
 WHEN status = 'done' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = request_id) THEN 'unanswered' WHEN status = 'failed' AND failure_count < 3 THEN 'retry' END AS why FROM q)
SELECT request_id, CASE WHEN why IS NOT NULL THEN 'pending' ELSE status END AS status, why FROM r""")
def q_resume_normalize(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"))
    return logs.resumed(requests(spark, d), have, 3).select("request_id", "status", "why")


@query(f"""WITH {REQUESTS_SQL}, t AS (SELECT DISTINCT request_id FROM q WHERE batch_id IS NOT NULL), r AS (SELECT l_orderkey AS request_id, CASE WHEN max(l_returnflag) = 'R' THEN 'bad' END AS error FROM lineitem GROUP BY 1)
SELECT request_id, CASE WHEN r.request_id IS NULL THEN 'missing' WHEN t.request_id IS NULL THEN 'unknown' WHEN error IS NOT NULL THEN 'failed' ELSE 'done' END AS outcome FROM t FULL JOIN r USING (request_id)""")
def q_batch_reconcile(spark, d):
    back = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.when(F.max("l_returnflag") == "R", "bad").alias("error"))
    return logs.reconcile(requests(spark, d).filter("batch_id is not null"), back)


@query("""SELECT split_part(replace(p_brand, '#', '/'), '/', 1) AS provider, substr(replace(p_brand, '#', '/'), strpos(replace(p_brand, '#', '/'), '/') + 1) AS model, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1, 2""")
def q_provider_groups(spark, d):
    key = F.replace("p_brand", F.lit("#"), F.lit("/"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda i: i.cast("string")), ",")
    return table(spark, d, "part").groupBy(C.provider(key).alias("provider"), C.model_name(key).alias("model")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query(f"""WITH {RESPONSES_SQL} SELECT item_id AS run_id, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM e GROUP BY 1""")
def q_run_cost(spark, d):
    r = responses(spark, d).select(F.col("item_id").alias("run_id"), F.col("seq").alias("request_id"), F.col("value").alias("cost_usd"), "seq")
    return logs.costs(r, "run_id").select("run_id", F.round(F.col("cost_usd") * 100).cast("long").alias("cents"))


@query(f"""WITH {RESPONSES_SQL}, c AS (SELECT item_id, seq, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY item_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM e)
SELECT item_id AS run_id, min(seq) FILTER (c >= 160000) AS warned_at, min(seq) FILTER (c >= 200000) AS stopped_at FROM c GROUP BY 1""")
def q_budget_trip(spark, d):
    r = responses(spark, d).select(F.col("item_id").alias("run_id"), "seq", F.round(F.col("value") * 100).alias("cost_usd"))
    return logs.budget_trip(r, 200_000, "run_id")


@query(f"""WITH {RESPONSES_SQL} SELECT item_id, arg_max(k, seq) FILTER (event_type = 'view') AS candidate, arg_max(k, seq) FILTER (event_type = 'click') AS quality, arg_max(value, seq) FILTER (event_type = 'purchase') AS evaluation FROM e GROUP BY 1""")
def q_round_upsert_fold(spark, d):
    only = lambda kind, c: F.when(F.col("event_type") == kind, F.col(c))
    e = responses(spark, d).select("item_id", "seq", only("view", "k").alias("candidate"), only("click", "k").alias("quality"), only("purchase", "value").alias("evaluation"))
    return logs.fold(e, ["item_id"], "seq", "candidate", "quality", "evaluation")


@query("""SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS feedback, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM conversations""")
def q_feedback_lag(spark, d):
    c = table(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("conv_id", "turn", logs.upcoming_feedback(c, F.length("text").cast("long"), "conv_id", "turn").alias("feedback"), F.count("*").over(before).alias("n_before"))


@query("""SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM conversations""")
def q_prior_history(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(logs.prior("role", "conv_id", "turn"), ">").alias("before"))


@query("""SELECT 'orders.o_custkey' AS link, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans
UNION ALL SELECT 'lineitem.l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'labels.doc_id', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def q_integrity(spark, d):
    tables = {t: table(spark, d, t) for t in ("orders", "customer", "lineitem", "labels", "documents")}
    return logs.integrity(tables, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")])


# ---------------------------------------------------------------- scores and verdicts

_R9 = "round({c}, 9) AS {c}"


@query(f"""WITH {REPORT_SQL} SELECT rnd, weak_n, strong_n, weak_max, weak_min, strong_max, strong_min, {', '.join(_R9.format(c=c) for c in ('weak_avg', 'strong_avg', 'weak_std', 'strong_std', 'gap'))} FROM p""")
def q_score_report(spark, d):
    r = scoring.report(attempts(spark, d), "rnd")
    return r.select("rnd", "weak_n", "strong_n", "weak_max", "weak_min", "strong_max", "strong_min", *(F.round(c, 9).alias(c) for c in ("weak_avg", "strong_avg", "weak_std", "strong_std", "gap")))


_WEAK_SQL = """CASE WHEN weak_avg > 0.65 THEN 'weak_avg ' || printf('%.3f', weak_avg) || ' > 0.65' END, CASE WHEN weak_max > 0.75 THEN 'weak_max ' || printf('%.3f', weak_max) || ' > 0.75' END,
 CASE WHEN weak_zeros > 0 THEN 'forbid_weak_zero: a weak score is 0.0' END"""
_VERDICT_SQL = f"""array_to_string(list_filter([{_WEAK_SQL}, CASE WHEN strong_avg < 0.6 THEN 'strong_avg ' || printf('%.3f', strong_avg) || ' < 0.6' END,
 CASE WHEN strong_avg >= 0.95 THEN 'strong_avg ' || printf('%.3f', strong_avg) || ' >= ceiling 0.95' END, CASE WHEN gap < 0.2 THEN 'gap ' || printf('%.3f', gap) || ' < min 0.2' END], lambda x: x IS NOT NULL), '; ')"""


@query(f"""WITH {REPORT_SQL}, v AS (SELECT *, {_VERDICT_SQL} AS reasons FROM p)
SELECT rnd, reasons = '' AS accepted, reasons, CASE WHEN reasons = '' THEN 'weak ' || printf('%.3f', weak_avg) || ', strong ' || printf('%.3f', strong_avg) || ', gap ' || printf('%.3f', gap) END AS rationale FROM v""")
def q_verdict_rubric(spark, d):
    v = scoring.rubric_verdict(scoring.report(attempts(spark, d), "rnd"))
    return v.select("rnd", "accepted", F.array_join("reasons", "; ").alias("reasons"), "rationale")


@query(f"""WITH {REPORT_SQL}, v AS (SELECT *, array_to_string(list_filter([CASE WHEN weak_correct > 1 THEN 'weak_correct ' || weak_correct || ' > 1 (too easy)' END, CASE WHEN strong_correct < 3 THEN 'strong_correct ' || strong_correct || ' < 3 (too hard)' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM p)
SELECT rnd, reasons = '' AS accepted, reasons FROM v""")
def q_verdict_verifiable(spark, d):
    return scoring.verifiable_verdict(scoring.report(attempts(spark, d), "rnd")).select("rnd", "accepted", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""WITH {REPORT_SQL} SELECT rnd, NOT (weak_avg > 0.65 OR weak_max > 0.75 OR weak_zeros > 0) AS gate, weak_correct <= 1 AS gate_verifiable FROM p""")
def q_weak_gate(spark, d):
    r = scoring.report(attempts(spark, d), "rnd")
    both = scoring.weak_gate(scoring.weak_gate(r, mode="verifiable").withColumnRenamed("gate", "gate_verifiable"))
    return both.select("rnd", "gate", "gate_verifiable")


@query(f"""WITH {REPORT_SQL} SELECT rnd, round(0 - weak_avg, 9) AS gap, false AS accepted, 'short_circuit: weak gate failed (too easy)' AS reasons FROM p WHERE weak_avg > 0.65 OR weak_max > 0.75 OR weak_zeros > 0""")
def q_short_circuit(spark, d):
    return scoring.short_circuit(scoring.report(attempts(spark, d), "rnd")).select("rnd", F.round("gap", 9).alias("gap"), "accepted", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""WITH {REPORT_SQL} SELECT rnd, weak_n >= 2 AS weak_done, weak_n >= 2 AND strong_n >= 2 AS all_done FROM p""")
def q_completion(spark, d):
    return scoring.completed(scoring.report(attempts(spark, d), "rnd"), 2, 2).select("rnd", "weak_done", "all_done")


@query("""WITH v AS (SELECT doc_id, quality = 1 AS accept, CASE WHEN toxic = 1 THEN ' toxic ' ELSE '' END AS reason, CASE WHEN doc_id % 3 = 0 THEN ' ask for detail ' END AS suggestion FROM labels)
SELECT doc_id, accept AS accepted, CASE WHEN accept THEN '' WHEN reason = '' THEN 'judge wants better' ELSE 'judge wants better: ' || reason END AS reasons,
 CASE WHEN NOT accept THEN coalesce(nullif(trim(suggestion), ''), nullif(trim(reason), ''), 'tell weak and strong answers apart better') END AS feedback FROM v""")
def q_judge_decision(spark, d):
    v = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("accept"), F.when(F.col("toxic") == 1, " toxic ").otherwise("").alias("reason"), F.when(F.col("doc_id") % 3 == 0, " ask for detail ").alias("suggestion"))
    return scoring.judge_decision(v).select("doc_id", "accepted", F.array_join("reasons", "; ").alias("reasons"), "feedback")


@query(f"""WITH {REPORT_SQL}, t AS (SELECT rnd, coalesce(string_agg(printf('%.2f', pts / 100.0), ',' ORDER BY attempt) FILTER (solver = 'weak'), '') AS weak_totals, coalesce(string_agg(printf('%.2f', pts / 100.0), ',' ORDER BY attempt) FILTER (solver = 'strong'), '') AS strong_totals FROM a GROUP BY rnd)
SELECT rnd, weak_totals, strong_totals, CAST(printf('%.3f', weak_avg) AS DOUBLE) AS weak_avg, CAST(printf('%.3f', gap) AS DOUBLE) AS gap FROM t JOIN p USING (rnd)""")
def q_scores_summary(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: C.fixed(x, 2)), ",").alias(c)
    return scoring.summary(attempts(spark, d), "rnd").select("rnd", text("weak_totals"), text("strong_totals"), "weak_avg", "gap")


@query("""WITH c AS (SELECT l_orderkey AS rnd, p_size AS id, arg_max(CAST(p_partkey % 7 + 1 AS INT), p_partkey) AS weight, max(CAST(round(l_discount * 100) AS BIGINT)) AS pts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT rnd, round(CAST(sum(weight * CASE WHEN id % 5 = 0 THEN 0 ELSE pts END) AS DOUBLE) / (100 * sum(weight)), 9) AS score FROM c GROUP BY rnd""")
def q_weighted_rubric(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entry = F.struct("p_partkey", F.col("p_size").cast("string").alias("id"), (F.col("p_partkey") % 7 + 1).cast("int").alias("weight"))
    points = j.groupBy(F.col("l_orderkey").alias("rnd"), "p_size").agg(F.max("l_discount").alias("v"))
    per = points.filter("p_size % 5 <> 0").groupBy("rnd").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_size").cast("string"), "v"))).alias("per"))
    rubric = j.groupBy(F.col("l_orderkey").alias("rnd")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e.id.alias("id"), e.weight.alias("weight"))).alias("rubric"))
    both = rubric.join(per, "rnd", "left").withColumn("per", F.coalesce("per", F.create_map().cast("map<string,double>")))
    return both.select("rnd", F.round(scoring.weighted_average(F.col("per"), F.col("rubric")), 9).alias("score"))


@query(f"""WITH {REPORT_SQL} SELECT rnd, rnd % 4 = 0 AS failed_quality, rnd % 4 <> 0 AND weak_avg > 0.65 AS too_easy, rnd % 4 <> 0 AND strong_n > 0 AND strong_avg < 0.6 AS failed_strong FROM p""")
def q_reflection_buckets(spark, d):
    r = scoring.report(attempts(spark, d), "rnd").withColumn("quality_passed", F.col("rnd") % 4 != 0)
    return scoring.buckets(r, 0.65, 0.60).select("rnd", "failed_quality", "too_easy", "failed_strong")


@query(f"""WITH {ATTEMPTS_SQL} SELECT DISTINCT rnd, solver, CAST(attempt AS INT) AS attempt FROM a WHERE completion_tokens >= max_tokens""")
def q_truncated(spark, d):
    return scoring.truncated(attempts(spark, d)).select("rnd", "solver", "attempt").distinct()


# ---------------------------------------------------------------- export


def _usable(spark, d):
    a = attempts(spark, d)
    return scoring.untruncated(a).filter(F.trim("raw_response") != "")


USABLE_SQL = ATTEMPTS_SQL + ", u AS (SELECT *, CASE solver WHEN 'weak' THEN 0 ELSE 1 END AS side FROM a WHERE NOT completion_tokens >= max_tokens)"


@query(f"""WITH {USABLE_SQL} SELECT rnd, CAST(attempt AS INT) AS attempt, raw_response FROM u WHERE solver = 'strong' AND pts >= 75 QUALIFY row_number() OVER (PARTITION BY rnd ORDER BY pts DESC, attempt) = 1""")
def q_best_strong(spark, d):
    return export.best_strong(_usable(spark, d), export.Guards(), "rnd").select("rnd", "best.attempt", "best.raw_response")


_RANKED_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY rnd ORDER BY pts DESC, side, attempt) AS up, row_number() OVER (PARTITION BY rnd ORDER BY pts, side DESC, attempt DESC) AS down, count(*) OVER (PARTITION BY rnd) AS n FROM {src})"""


@query(f"""WITH {USABLE_SQL}{_RANKED_SQL.format(src='u')} SELECT c.rnd, c.raw_response AS chosen, j.raw_response AS rejected, c.solver AS chosen_solver, j.solver AS rejected_solver, c.pts - j.pts AS margin
 FROM r c JOIN r j ON c.rnd = j.rnd WHERE c.up = 1 AND j.down = 1 AND c.n >= 2 AND c.pts >= 75 AND c.pts - j.pts >= 30 AND c.raw_response <> j.raw_response""")
def q_dpo_pairs(spark, d):
    u = _usable(spark, d).withColumn("total", F.col("pts").cast("double"))
    p = export.pairs(u, export.Guards(min_chosen=75, min_margin=30), "rnd")
    return p.select("rnd", F.col("chosen.raw_response").alias("chosen"), F.col("rejected.raw_response").alias("rejected"), F.col("chosen.solver").alias("chosen_solver"), F.col("rejected.solver").alias("rejected_solver"), (F.col("chosen.total") - F.col("rejected.total")).cast("long").alias("margin"))


@query(f"""WITH {USABLE_SQL}, y AS (SELECT * FROM u WHERE correct QUALIFY row_number() OVER (PARTITION BY rnd ORDER BY pts DESC, side, attempt) = 1), n AS (SELECT * FROM u WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY rnd ORDER BY pts, side DESC, attempt DESC) = 1)
SELECT y.rnd, y.raw_response AS chosen, n.raw_response AS rejected FROM y JOIN n USING (rnd) WHERE y.raw_response <> n.raw_response""")
def q_dpo_verifiable(spark, d):
    p = export.pairs(_usable(spark, d), export.Guards(verifiable=True), "rnd")
    return p.select("rnd", F.col("chosen.raw_response").alias("chosen"), F.col("rejected.raw_response").alias("rejected"))


@query(f"""WITH {REPORT_SQL} SELECT rnd, round(weak_std, 4) AS weak_std, round(strong_std, 4) AS strong_std FROM p WHERE weak_n > 0 AND strong_n > 0""")
def q_grpo_stats(spark, d):
    r = scoring.report(attempts(spark, d), "rnd").filter("weak_n > 0 and strong_n > 0")
    return r.select("rnd", F.round("weak_std", 4).alias("weak_std"), F.round("strong_std", 4).alias("strong_std"))


@query("""SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) || '|assistant:' || length(max(text)) AS messages, count(*) + 1 AS n FROM conversations GROUP BY conv_id""")
def q_sft_messages(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.max("text").alias("reference_output"))
    prompt = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    rows = c.select(F.col("conv_id").alias("item_id"), F.col("conv_id").alias("accepted_seq"), prompt.alias("prompt"), "reference_output")
    rows = export.build(rows.withColumn("prompt", F.concat(F.array(F.struct(F.lit("id").alias("role"), F.col("item_id").cast("string").alias("content"))), "prompt")), "sft")
    text = F.array_join(F.transform(F.slice("messages", F.lit(2), F.size("messages")), lambda m: F.concat(m.role, F.lit(":"), F.length(m.content).cast("string"))), "|")
    return rows.select(F.col("item_id").alias("conv_id"), text.alias("messages"), (F.size("messages") - 1).cast("long").alias("n"))


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def q_prompt_dedup(spark, d):
    return export.first_of_prompt(table(spark, d, "documents"), "doc_id", prompt="text").select("doc_id", "source")


@query(r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') THEN 'pii:SSN' END, CASE WHEN regexp_matches(text, '\b(?:[0-9][ -]*?){13,19}\b') THEN 'pii:credit-card-like' END,
 CASE WHEN regexp_matches(text, '\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b') THEN 'pii:email' END) AS reasons FROM documents""")
def q_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.pii_reasons("text"), ",").alias("reasons"))


@query(r"""WITH t AS (SELECT doc_id, rtrim(regexp_extract(replace(text, ',', ''), '-?[0-9]+/[0-9]+|-?[0-9]*\.[0-9]+|-?[0-9]+\.?[0-9]*'), '.') AS n FROM documents)
SELECT doc_id, CASE WHEN n <> '' AND length(n) <= 18 AND NOT contains(n, '/') THEN CAST(n AS DOUBLE) END AS value FROM t""")
def q_answer_number(spark, d):
    n = C.number("text")
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.when(F.col("n").isNotNull(), F.col("n.num").cast("double") / F.col("n.den").cast("double")).alias("value"))


@query("""WITH m AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN n WHEN role = 'system' THEN n ELSE n + 1 END AS n, CASE WHEN conv_id % 3 = 0 THEN text WHEN role = 'system' THEN text || chr(10) || chr(10) || 'Further rules:' || chr(10) || '- cite' || chr(10) || '- be brief' ELSE 'Further rules:' || chr(10) || '- cite' || chr(10) || '- be brief' END AS first FROM m""")
def q_rule_injection(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    rules = F.when(F.col("conv_id") % 3 != 0, F.array(F.lit("cite"), F.lit("be brief")))
    out = c.withColumn("x", C.with_rules(F.col("m"), rules))
    return out.select("conv_id", F.size("x").cast("long").alias("n"), F.element_at("x", 1).content.alias("first"))


# ---------------------------------------------------------------- evaluation of rules


@query(f"""WITH {REPORT_SQL}, v AS (SELECT rnd, {_VERDICT_SQL} AS reasons FROM p), x AS (SELECT unnest(string_split(reasons, '; ')) AS r FROM v WHERE rnd % 4 <> 0 AND reasons <> ''),
y AS (SELECT split_part(r, ' ', 1) AS reason FROM x UNION ALL SELECT 'quality:leak' FROM v WHERE rnd % 4 = 0) SELECT reason, count(*) AS n FROM y GROUP BY 1""")
def q_failure_histogram(spark, d):
    v = scoring.rubric_verdict(scoring.report(attempts(spark, d), "rnd")).withColumns({"ord": F.col("rnd"), "quality_passed": F.col("rnd") % 4 != 0, "failures": F.array(F.lit("leak: in context"))})
    return scoring.failure_histogram(v)[1]


@query(f"""WITH {REPORT_SQL}, v AS (SELECT rnd % 7 AS harness, {_VERDICT_SQL} = '' AS ok FROM p) SELECT harness, round(count(*) FILTER (ok) / greatest(count(*), 1), 9) AS rate FROM v GROUP BY 1""")
def q_acceptance_rate(spark, d):
    from rolloom.operators.evolve import acceptance_rate

    v = scoring.rubric_verdict(scoring.report(attempts(spark, d), "rnd")).withColumn("harness", F.col("rnd") % 7)
    return acceptance_rate(v, "harness").select("harness", F.round("rate", 9).alias("rate"))


@query("""WITH h AS (SELECT c_custkey AS idx, c_acctbal / 1000.0 AS score FROM customer), w AS (SELECT idx, exp((score - max(score) OVER ()) / 2.0) AS w FROM h),
c AS (SELECT idx, w / sum(w) OVER () AS share, sum(w) OVER (ORDER BY idx) / sum(w) OVER () AS cum FROM w) SELECT idx, round(share, 9) AS share, idx = (SELECT min(idx) FROM c WHERE cum >= 0.37) AS picked FROM c""")
def q_softmax_pick(spark, d):
    from rolloom.operators.evolve import softmax_pick

    h = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal") / 1000.0).alias("score"))
    return softmax_pick(h, 2.0, 0.37).select("idx", F.round("share", 9).alias("share"), "picked")


@query("""SELECT n_regionkey AS grp, max(n_nationkey) FILTER (n_nationkey % 3 <> 0) AS last_accepted, arg_max(n_nationkey, (n_nationkey % 5, -n_nationkey)) FILTER (n_nationkey % 3 <> 0) AS best FROM nation GROUP BY 1""")
def q_best_harness(spark, d):
    from rolloom.operators.evolve import best_record

    r = table(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") % 5).cast("double").alias("val_mean"), F.lit(0.0).alias("train_score"), (F.col("n_nationkey") % 3 != 0).alias("accepted"))
    last = r.filter("accepted").groupBy("grp").agg(F.max("idx").alias("last_accepted"))
    return best_record(r, "grp").join(last, "grp").select("grp", "last_accepted", F.col("idx").alias("best"))


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'seed', 1, doc_id)), doc_id) AS n FROM labels) SELECT doc_id, CASE WHEN n <= 6 THEN 'train' ELSE 'val' END AS part FROM s WHERE n <= 10""")
def q_split(spark, d):
    from rolloom.operators.evolve import split

    return split(table(spark, d, "labels").select("doc_id"), "doc_id", 6, 4, 1)


# ---------------------------------------------------------------- texts and numbers of replies


@query("""SELECT p_partkey, greatest(1, least(7, coalesce(CAST(trunc(try_cast(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_retailprice - 900 AS VARCHAR) END AS DOUBLE)) AS INT), 1))) AS weight FROM part""")
def q_rubric_weight(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise((F.col("p_retailprice") - 900).cast("string"))
    return table(spark, d, "part").select("p_partkey", C.weight(text, 7).alias("weight"))


@query("""SELECT event_id, greatest(0.0, least(1.0, CASE WHEN event_id % 7 <> 0 THEN value / 50.0 - 0.5 END)) AS score FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, CAST(NULL AS DOUBLE) FROM events WHERE event_id % 7 = 0""")
def q_clamp(spark, d):
    x = F.when(F.col("event_id") % 7 != 0, F.col("value") / 50.0 - 0.5)
    return table(spark, d, "events").select("event_id", C.clamp(x).alias("score"))


@query("""SELECT p_brand, string_agg('- ' || substr(p_name, 1, 12), chr(10) ORDER BY p_partkey) AS lines FROM part GROUP BY p_brand""")
def q_bullets(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x.p_name)
    return table(spark, d, "part").groupBy("p_brand").agg(names.alias("names")).select("p_brand", C.bullets("names", 12).alias("lines"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def q_joined_messages(spark, d):
    m = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", C.joined_messages("m").alias("text"))


@query("""WITH r AS (SELECT conv_id, role || ':' || turn AS rule, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, coalesce(string_agg(rule, '|' ORDER BY i) FILTER (i NOT IN (0, 2)) || '|', '') || 'be brief' AS rules FROM r GROUP BY conv_id""")
def q_edited_rules(spark, d):
    rules = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x.role, x.turn.cast("string")))
    r = table(spark, d, "conversations").groupBy("conv_id").agg(rules.alias("rules"))
    edited = C.edited_rules("rules", F.array(F.lit(0), F.lit(2), F.lit(99)), F.array(F.lit("  be brief "), F.lit("  ")))
    return r.select("conv_id", F.array_join(edited, "|").alias("rules"))


@query(f"""WITH {RESPONSES_SQL} SELECT seq, CASE WHEN k % 5 = 0 THEN 1 ELSE CAST(k AS INT) END AS round_n FROM e""")
def q_peek_round(spark, d):
    said = F.when(F.col("k") % 5 == 0, F.lit("nothing of a number 7")).otherwise(F.concat(F.lit("this is ROUND: "), F.col("k").cast("string"), F.lit(" of many")))
    return responses(spark, d).select("seq", C.peek_round(said).alias("round_n"))


@query("""SELECT event_id, props FROM events""")
def q_unfenced(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", C.unfenced(fenced).alias("props"))


@query(f"""WITH {RESPONSES_SQL} SELECT seq, k % 3 = 0 AS equal FROM e""")
def q_equal_numbers(spark, d):
    one = F.concat(F.col("k").cast("string"), F.lit("/4"))
    two = (F.col("k") * 25 + F.when(F.col("k") % 3 == 0, 0).otherwise(1)).cast("decimal(12,0)")
    two = F.concat(F.floor(two / 100).cast("string"), F.lit("."), F.lpad((two % 100).cast("int").cast("string"), 2, "0"))
    return responses(spark, d).select("seq", C.equal_numbers(C.number(one), C.number(two)).alias("equal"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_salvaged_json(spark, d):
    from rolloom.functions import replies

    def read(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "k": [replies.salvage(f"Here it is:\n```json\n{p}\n```\nThat was all." if i % 2 else f"so {p} then")["k"] for i, p in zip(b["event_id"], b["props"])]})

    return table(spark, d, "events").select("event_id", "props").mapInPandas(read, "event_id long, k long")


@query("""SELECT user_id AS item_id, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def q_latest_event(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), "event_type")
    return logs.latest(e, ["item_id"], "seq").select("item_id", "seq", "event_type")


@query("""SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS reason FROM orders""")
def q_reason_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.reason_key("o_orderpriority", "-").alias("reason"))
