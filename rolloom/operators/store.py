"""The tables of a run: append-only logs in a directory, and current state as queries over them.

One driver writes. An append is one directory that is written aside and renamed, so that it is there as a whole
or not at all; a superstep's items, requests, rounds and scores are one append.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom import schemas
from rolloom.operators import logs


#: Bits of a sequence number for the row within a partition and for the partition; the batch has the other 18.
ROW_BITS, PARTITION_BITS = 30, 15


def sequence(batch, ord_):
    """A number for each row of a log, rising with batch, partition and row, unique up to 2 ** ROW_BITS rows in a partition; an
    error beyond any of the bounds, as equal numbers would lose rows. ord_: partition and row as monotonically_increasing_id has them."""
    row, part = ord_.bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(ord_, 33)
    fits = (row < 1 << ROW_BITS) & (part < 1 << PARTITION_BITS) & (batch < 1 << (63 - ROW_BITS - PARTITION_BITS))
    at = F.shiftleft(batch, ROW_BITS + PARTITION_BITS) + F.shiftleft(part, ROW_BITS) + row
    return F.when(fits, at).otherwise(F.raise_error(F.lit("a log has too many rows, partitions or batches to number")).cast("long"))


class RunStore:
    def __init__(self, spark: SparkSession, path: str, cap: int = 3):
        self.spark, self.path, self.cap = spark, path.rstrip("/"), cap
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        version = self._path(f"{self.path}/_schema_version={schemas.VERSION}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.path))] if self.fs.exists(self._path(self.path)) else []
        for name in found:
            if name.startswith("_schema_version=") and int(name.split("=")[1]) > schemas.VERSION:
                raise RuntimeError(f"{self.path} was written by a newer version")
        self.fs.mkdirs(version)
        self.batches = {t: self._count(t) for t in schemas.LOGS}
        self.next = max([0, *(b for x in self.batches.values() for b in x)]) + 1

    def _count(self, table: str) -> list[int]:
        at = self._path(f"{self.path}/{table}")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(at) if s.getPath().getName().startswith("batch=")) if self.fs.exists(at) else []

    def append(self, table: str, df: DataFrame) -> DataFrame:
        """Adds rows as the next batch, and gives them back as read from there."""
        aside = f"{self.path}/_writing/{table}"
        columns = [f.split()[0] for f in _split(schemas.LOGS[table])]
        df.select(*columns, F.monotonically_increasing_id().alias("ord")).write.mode("overwrite").parquet(aside)
        self.fs.mkdirs(self._path(f"{self.path}/{table}"))
        if not self.fs.rename(self._path(aside), self._path(f"{self.path}/{table}/batch={self.next}")):
            raise RuntimeError(f"{table}: the batch could not be put in place")
        self.batches[table].append(self.next)
        self.next += 1
        return self.log(table).filter(F.col("batch") == self.next - 1)

    def log(self, table: str) -> DataFrame:
        """All rows, with seq: by batch, then by place in it."""
        schema = f"{schemas.LOGS[table]}, ord long, batch long"
        if not self.batches[table]:
            return self.spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/batch={b}" for b in self.batches[table]))
        return df.withColumn("seq", sequence(F.col("batch"), F.col("ord")))

    # ------------------------------------------------------------ current state

    def _kind(self, kind: str) -> DataFrame:
        return self.log("steps").filter(F.col("kind") == kind)

    def items(self) -> DataFrame:
        """One row an item, with its state as JSON in `blob`."""
        last = self._kind("item").groupBy("item_id").agg(F.max_by("payload", "seq").alias("blob"), F.max("consumed_seq").alias("consumed_seq"), F.min("seq").alias("created_seq"), F.max("seq").alias("updated_at"))
        return last.withColumn("j", F.from_json("blob", schemas.ITEM)).select("item_id", "j.run_id", "j.source_id", "j.domain", "j.state", F.col("j.round").alias("current_round"), "j.reasons", "blob", "consumed_seq", "created_seq", "updated_at")

    def responses(self) -> DataFrame:
        """First good reply of each request."""
        good = self.log("calls").filter("error is null")
        return logs.insert_if_absent(good.drop("ord", "batch", "error"), self.spark.createDataFrame([], "request_id string"), ["request_id"], "seq")

    def requests(self) -> DataFrame:
        """Requests with status, failure_count, last_error and batch_id."""
        first = self._kind("request").groupBy(F.get_json_object("payload", "$.request_id").alias("request_id")).agg(F.min_by("payload", "seq").alias("payload"), F.min("seq").alias("seq"))
        own = first.withColumn("j", F.from_json("payload", schemas.REQUEST)).select("request_id", *(f"j.{f.split()[0]}" for f in _split(schemas.REQUEST) if not f.startswith("request_id")), "payload", "seq")
        calls = self.log("calls").groupBy("request_id").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("failure_count"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"))
        tags = self.log("tags").groupBy("request_id").agg(F.max_by(F.struct("batch_id"), "seq").alias("t")).select("request_id", "t.batch_id")
        out = own.join(calls, "request_id", "left").join(tags, "request_id", "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))
        status = F.when(F.col("good") > 0, "done").when(F.col("failure_count") >= self.cap, "failed").when(F.col("batch_id").isNotNull(), "in_flight").otherwise("pending")
        return out.withColumn("status", status).drop("good")

    def hydrated(self) -> DataFrame:
        return logs.hydrate(self.responses(), self.requests())

    def rounds(self) -> DataFrame:
        """Finished rounds, each once: a replayed step gives the same."""
        j = self._kind("round").select("item_id", F.from_json("payload", schemas.ROUND).alias("j"), "seq").select("item_id", "j.*", "seq")
        return logs.latest(j, ["item_id", "round_n"], "seq")

    def scores(self) -> DataFrame:
        j = self._kind("score").select("item_id", F.get_json_object("payload", "$.round_n").cast("int").alias("round_n"), F.from_json("payload", schemas.SCORE).alias("j"), "seq").select("item_id", "round_n", "j.*", "seq")
        return logs.insert_if_absent(j, self.spark.createDataFrame([], "item_id string, round_n int, solver string, attempt int"), ["item_id", "round_n", "solver", "attempt"], "seq")

    def accepted(self) -> DataFrame:
        """Accepted records; payload is all of it as JSON."""
        first = self._kind("accepted").groupBy("item_id").agg(F.min_by("payload", "seq").alias("payload"), F.min("seq").alias("accepted_seq"))
        return first.withColumn("j", F.from_json("payload", schemas.ACCEPTED)).select("item_id", *(f"j.{f.split()[0]}" for f in _split(schemas.ACCEPTED) if not f.startswith("item_id")), "payload", "accepted_seq")

    def truncated(self) -> DataFrame:
        """Attempts that used up max_tokens, by item, round, solver and attempt."""
        q = self.requests().filter(F.col("role").isin("weak", "strong"))
        both = q.join(self.responses().select("request_id", "completion_tokens"), "request_id").filter("completion_tokens >= max_tokens")
        return both.select("item_id", F.col("round_n").alias("refinement_round"), F.col("role").alias("solver"), "attempt").distinct()

    def trajectory(self) -> DataFrame:
        """Rounds of each item, in order."""
        own = F.struct("round_n", "quality", "evaluation", "accepted")
        return self.rounds().groupBy("item_id").agg(F.array_sort(F.collect_list(own), lambda a, b: a.round_n - b.round_n).alias("rounds"))

    def cost(self) -> float:
        return self.responses().agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]

    def run(self) -> dict | None:
        rows = self.log("runs").groupBy("run_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("config", "harness")), F.max_by("event", "seq").alias("status"), F.min("at").alias("started_at"), F.max("at").alias("last_active_at"), F.max(F.when(F.col("event").isin("completed", "aborted"), F.col("at"))).alias("finished_at")).collect()
        return rows[0].asDict() if rows else None

    def mark(self, run_id: str, event: str, config: dict | None = None, harness: str | None = None) -> None:
        row = [(run_id, event, json.dumps(config) if config else None, harness)]
        self.append("runs", self.spark.createDataFrame(row, "run_id string, event string, config string, harness string").withColumn("at", F.current_timestamp()))

    def integrity(self) -> DataFrame:
        t = {"scores": self.scores(), "rounds": self.rounds(), "accepted": self.accepted(), "requests": self.requests(), "responses": self.responses(), "items": self.items()}
        return logs.integrity(t, [("scores", "item_id", "items", "item_id"), ("rounds", "item_id", "items", "item_id"), ("accepted", "item_id", "items", "item_id"), ("requests", "item_id", "items", "item_id"), ("responses", "request_id", "requests", "request_id")])


def _split(ddl: str) -> list[str]:
    """The fields of a DDL schema."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]
