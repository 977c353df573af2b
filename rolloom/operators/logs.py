"""Current state from append-only logs: folds, ready items, request life cycle, costs, resume, batch reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("ACCEPTED", "REJECTED")


def fold(events: DataFrame, keys: list[str], order: str | list[str], *columns: str) -> DataFrame:
    """Per key the last value of each column that isn't null: the upsert of partial updates."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    return events.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns))


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the whole last event."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e")).select(*keys, "_e.*")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `new` to append: keys that aren't there yet, once each, the first by `order`."""
    rest = [c for c in new.columns if c not in keys]
    once = new.dropDuplicates(keys) if order is None else new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_e")).select(*keys, "_e.*")
    return once.select(*new.columns).join(existing.select(*keys), keys, "left_anti")


def open_(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("state").isin(*TERMINAL))


def state_counts(items: DataFrame, *keys: str) -> DataFrame:
    """How many items are in each state, terminal or not."""
    return items.groupBy(*keys, "state").agg(F.count("*").alias("n"))


def stuck(items: DataFrame) -> DataFrame:
    return open_(items).select("item_id", "source_id", "state", "current_round", "updated_at").orderBy("updated_at", "item_id")


def ready(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Open items with a response beyond what they have consumed: a semi join with an inequality."""
    i, r = open_(items).alias("i"), responses.select(F.col("item_id").alias("r_item"), F.col("seq").alias("r_seq")).alias("r")
    return i.join(r, (F.col("i.item_id") == F.col("r_item")) & (F.col("r_seq") > F.coalesce("i.consumed_seq", F.lit(-1))), "left_semi")


def hydrate(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses with their request and, for judges, the solver's role and text that they judge."""
    own = requests.select("request_id", "item_id", "round_n", "role", "attempt", "parent_response_id")
    parent = requests.select(F.col("request_id").alias("parent_response_id"), F.col("role").alias("p_role"))
    text = responses.select(F.col("request_id").alias("parent_response_id"), F.col("text").alias("p_text"))
    out = responses.drop("item_id").join(own, "request_id").join(parent, "parent_response_id", "left").join(text, "parent_response_id", "left")
    judged = (F.col("role") == "judge") & F.col("parent_response_id").isNotNull()
    return out.withColumns({"solver_role": F.when(judged, F.col("p_role")), "solver_text": F.when(judged, F.col("p_text"))}).drop("p_role", "p_text")


def first_of_role(hydrated: DataFrame, role: str, *keys: str) -> DataFrame:
    """Per key the response of the role with the smallest request id."""
    return hydrated.filter(F.col("role") == role).groupBy(*keys).agg(F.min_by("text", "request_id").alias("text"))


def first_by_role(responses: DataFrame, value: str, *keys: str, role: str = "role", order: str = "seq") -> DataFrame:
    """Per key and role the first response's number and value, and the last number, up to which the responses are consumed."""
    return responses.groupBy(*keys, role).agg(F.min(order).alias("request_id"), F.max(order).alias("consumed_seq"), F.min_by(value, order).alias(value))


def pending_counts(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, pending, in_flight) of requests by the runs (item_id, run_id) of their items."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return requests.join(runs, "item_id").groupBy("run_id").agg(n("pending"), n("in_flight"))


def prior(value: Column | str, key: str, order: str) -> Column:
    """The values of the same key that come before, in order."""
    return F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def claim(requests: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first n pending requests."""
    return requests.filter("status = 'pending'").orderBy(order).limit(n)


def after_failures(requests: DataFrame, failures: DataFrame, cap: int) -> DataFrame:
    """requests with failure_count, last_error and status: failed at the cap, pending below it."""
    count = failures.groupBy("request_id").agg(F.count("*").alias("failure_count"), F.max_by("error", "seq").alias("last_error"))
    out = requests.join(count, "request_id", "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))
    return out.withColumn("status", F.when(F.col("failure_count") >= cap, "failed").when(F.col("failure_count") > 0, "pending").otherwise(F.col("status")))


def unrecoverable(items: DataFrame, requests: DataFrame, cap: int) -> DataFrame:
    """(item_id, error) of open items with a request that failed for good; error: the largest text."""
    bad = requests.filter((F.col("status") == "failed") & (F.col("failure_count") >= cap)).select("item_id", "last_error")
    return open_(items).select("item_id").join(bad, "item_id").groupBy("item_id").agg(F.max("last_error").alias("error"))


def resumed(requests: DataFrame, responses: DataFrame, cap: int) -> DataFrame:
    """requests with the status that a resumed run gives them, and why: in flight without a batch, done without a
    response, or failed below the cap, they are pending again."""
    have = responses.select("request_id").distinct().withColumn("_have", F.lit(True))
    out = requests.join(have, "request_id", "left")
    why = (
        F.when((F.col("status") == "in_flight") & F.col("batch_id").isNull(), "lost")
        .when((F.col("status") == "done") & F.col("_have").isNull(), "unanswered")
        .when((F.col("status") == "failed") & (F.col("failure_count") < cap), "retry")
    )
    return out.withColumn("why", why).withColumn("status", F.when(F.col("why").isNotNull(), "pending").otherwise(F.col("status"))).drop("_have")


def reconcile(tagged: DataFrame, returned: DataFrame) -> DataFrame:
    """(request_id, outcome): done, or failed as the provider says, for ids on both sides; missing for those it left
    out; unknown for those that nobody asked for."""
    t = tagged.select("request_id").distinct().withColumn("_t", F.lit(True))
    r = returned.select("request_id", F.col("error").alias("_error")).withColumn("_r", F.lit(True))
    outcome = F.when(F.col("_r").isNull(), "missing").when(F.col("_t").isNull(), "unknown").when(F.col("_error").isNotNull(), "failed").otherwise("done")
    return t.join(r, "request_id", "full_outer").select("request_id", outcome.alias("outcome"))


def costs(responses: DataFrame, *keys: str) -> DataFrame:
    """The sum of known costs of first responses."""
    first = responses.groupBy(*keys, "request_id").agg(F.min_by("cost_usd", "seq").alias("cost_usd"))
    return first.groupBy(*keys).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def budget_trip(responses: DataFrame, cap: float, *keys: str, warn: float = 0.8) -> DataFrame:
    """Per key the first sequence numbers at which the running cost reaches the warning and the cap."""
    by = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = responses.withColumn("_so_far", F.sum(F.coalesce("cost_usd", F.lit(0.0))).over(by))
    at = lambda limit: F.min(F.when(F.col("_so_far") >= limit, F.col("seq")))
    return run.groupBy(*keys).agg(at(cap * warn).alias("warned_at"), at(cap).alias("stopped_at"))


def integrity(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """(link, orphans): rows whose reference leads nowhere, for links of (table, column, to table, to column)."""
    out: DataFrame | None = None
    for table, column, to, to_column in links:
        lost = tables[table].filter(F.col(column).isNotNull()).join(tables[to].select(F.col(to_column).alias(column)), column, "left_anti")
        row = lost.agg(F.count("*").alias("orphans")).select(F.lit(f"{table}.{column}").alias("link"), "orphans")
        out = row if out is None else out.unionByName(row)
    assert out is not None, "no links given"
    return out


def upcoming_feedback(rounds: DataFrame, value: Column | str, key: str = "item_id", order: str = "round_n") -> Column:
    """The value of the round before, as a window expression."""
    return F.lag(value).over(Window.partitionBy(key).orderBy(order))
