"""Operator 8: mixing sources to target weights.

The words of each source, document after document, are packed into blocks of BLOCK words. Output is made of shards of
about SHARD slots. Each shard draws how many of its slots each source gets: the whole part of what its target share
comes to is certain, what is left over is one multinomial draw over the fractions (residual sampling, so that a
source's sum strays from its target by about the square root of the number of shards, in blocks). The slots of a source
are numbered from shard to shard, and slot q is mapped to block p(q mod blocks) by a pseudorandom permutation p of its
block numbers, another one for each pass over the source. Blocks are then joined to slots by number. No source goes
round more than CAP times: slots beyond stay empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rolloom.llm.common import keyed, mix, ranked, small, stored, unpacked

BLOCK = 128
#: Most slots of an output shard, on average.
SHARD = 4096
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Documents of a source that one task puts in order, and shards of a source that one task numbers.
CHUNK, SHARDS = 50_000, 4096
SEED = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse: a Feistel network of four rounds, walked until it is in range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    key = mix(np.arange(4, dtype=np.uint64) + np.uint64(seed % 2**63) * np.uint64(4))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in key[::-1] if inverse else key:
            if inverse:
                left, right = right ^ (mix(left + k) & low), left
            else:
                left, right = right, left ^ (mix(right + k) & low)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size), each source once.

    Sources by code point, null last, weigh `weights`, repeating. share x all sizes is dealt by weight; what a
    target has over cap x its source is dealt again until none has. Empty: no rows.
    """
    order = ranked(sizes, F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    s = stored(order.select(F.col("rank").alias("sid"), "source", "source_size", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).cast("double").alias("w")))
    whole, all_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    rate, full = (share * whole / all_w if whole else 0.0), -1
    while whole:  # the rate only rises, so who is full stays so
        over = F.col("w") * rate > cap * F.col("source_size")
        n, spent, w = s.agg(F.count_if(over), F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == full or not w:
            break
        rate, full = (share * whole - (spent or 0.0)) / w, n
    return s.select("sid", "source", "source_size", F.least(F.col("w") * rate, F.lit(float(cap)) * F.col("source_size")).alias("target"))


def drawn(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(sid, shard, n): how many slots each shard gives each source, from (sid, slots): a source's slots in all shards.

    A shard surely has floor(slots / shards) of each source; one draw over the rests fills it up. Only sources with
    a sure slot in each shard, no more than a shard has slots, are multiplied by shards. Empty: no rows.
    """
    spark = sources.sparkSession
    each = sources.withColumn("sure", F.floor(F.col("slots") / shards)).withColumn("rest", F.col("slots") / shards - F.col("sure")).withColumn("part", F.floor(F.col("sid") / CHUNK))
    sums = each.groupBy("part").agg(F.sum("rest").alias("all")).orderBy("part").collect()  # one row for CHUNK sources
    at, bases = 0.0, []
    for r in sums:
        bases.append((r["part"], at))
        at += r["all"] or 0.0
    sure = each.filter("sure > 0").select("sid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("sure").alias("n"))
    draws = int(at * shards + 1e-9)
    if not draws:
        return sure
    base = spark.createDataFrame(bases, "part long, base double")
    before = F.sum("rest").over(Window.partitionBy("part").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rest")
    spans = each.withColumn("lo", before).join(F.broadcast(base), "part").withColumn("lo", F.col("lo") + F.col("base")).withColumn("hi", F.col("lo") + F.col("rest")).filter("hi > lo")
    fine = max(1.0, sources.count() / at)  # cells of the draw's range, about one for each source
    cell = lambda x: F.floor(x * fine).cast("long")
    spans = spans.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53) * at
    draw = spark.range(draws).select(F.floor(F.col("id") / at).alias("shard"), u.alias("u")).withColumn("shard", F.least("shard", F.lit(shards - 1))).withColumn("cell", cell(F.col("u")))
    hits = draw.join(spans, "cell").filter("u >= lo and u < hi")
    return sure.union(hits.select("sid", "shard", F.lit(1).cast("long").alias("n"))).groupBy("sid", "shard").agg(F.sum("n").alias("n"))


def numbered(counts: DataFrame) -> DataFrame:
    """counts (sid, shard, n) with q, the first slot of the source in the shard; a source's shards are summed up by chunks."""
    counts = stored(counts.withColumn("chunk", F.floor(F.col("shard") / SHARDS)))
    totals = counts.groupBy("sid", "chunk").agg(F.sum("n").alias("all"))
    first = F.sum("all").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")
    inner = F.sum("n").over(Window.partitionBy("sid", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("q", inner).join(totals.select("sid", "chunk", first.alias("base")), ["sid", "chunk"]).select("sid", "shard", "n", (F.col("q") + F.col("base")).alias("q"))


def _seed(name: int, turn: int, seed: int) -> int:
    return int(mix(np.array([(name % 2**64) ^ (turn * 0x9E3779B97F4A7C15 + seed) % 2**64], np.uint64))[0]) >> 2


def _slots(block: int, cap: int, seed: int):
    """(sid, block, shard, turn) for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sid, name, size, shard, q, n in zip(*(c.to_pylist() for c in b.columns)):
                blocks = -(-size // block)
                slot = np.arange(q, min(q + n, cap * blocks))
                turn, at = slot // blocks, slot % blocks
                for t in np.unique(turn).tolist():
                    index = permute(at[turn == t], blocks, _seed(name, t, seed))
                    out.append((np.full(len(index), sid), index, np.full(len(index), shard), np.full(len(index), t)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["sid", "block", "shard", "turn"])

    return run


def _drawn(docs: DataFrame, block: int, seed: int, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with sid, offset and target; slots; segments of the documents by block with the slots that take them)."""
    name = F.col("source").cast("string")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), word_count(F.col("text").cast("string")).alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sums))
    count = rows.count()
    chunk = F.pmod(F.xxhash64("doc_id", "th"), F.lit(-(-count // CHUNK) or 1))
    placed = rows.join(small(sources).withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("chunk", chunk)
    totals = rows.withColumn("chunk", chunk).groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    totals = small(stored(totals.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), "base")))
    by = Window.partitionBy("sid", "chunk").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("off", F.sum("size").over(by) - F.col("size"))
    placed = placed.join(totals, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))).withColumn("off", F.col("off") + F.col("base"))
    placed = stored(placed.select("doc_id", "source", "th", "size", "sid", "source_size", "target", "off"))

    full = sources.filter("source_size > 0").select("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).alias("name"), "source_size", (F.col("target") / F.col("source_size") * F.ceil(F.col("source_size") / block)).alias("slots"))
    shards = max(1, math.ceil((full.agg(F.sum("slots")).first()[0] or 0) / shard))
    plan = numbered(drawn(full.select("sid", "slots"), shards, seed)).join(small(stored(full)), "sid").select("sid", "name", "source_size", "shard", "q", "n")
    slots = plan.repartition("shard").mapInArrow(_slots(block, CAP, seed), "sid long, block long, shard long, turn long")
    lo, hi = F.col("off"), F.col("off") + F.col("size")
    segments = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence((lo / block).cast("long"), ((hi - 1) / block).cast("long"))))
        .select("doc_id", "source", "th", "size", "source_size", "target", "sid", "off", "block", F.greatest(lo - F.col("block") * block, F.lit(0)).alias("a"), F.least(hi - F.col("block") * block, F.lit(block)).alias("b"))
    )
    # slots have many times the rows of the plan by whose size adaptive planning would judge them
    taken = segments.join(slots.hint("merge"), ["sid", "block"])
    return placed, slots, taken


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs.

    Null text: size 0. Null source: a source of its own, last. Null or repeated doc_id: rows stay apart; equal
    rows change places freely. Empty table: no rows. Reruns agree, whatever the partitions. Other columns are
    ignored. taken is at most CAP times size, as no source goes round more often; a source's sum comes near its target,
    within some blocks more or less as the draw has it.
    """
    placed, _, taken = _drawn(docs, block, seed, shard)
    sums = taken.groupBy("sid", "off").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    both = placed.join(sums.withColumn("some", F.lit(True)), ["sid", "off"], "left")
    return both.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and pass over its source the words that are taken, in the order of the text."""
    for b in batches:
        rows, text = [], []
        for i, (t, takes) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            words = t.encode().split()
            by: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for x in takes:
                by.setdefault((x["turn"], x["off"]), []).append((x["lo"], x["hi"]))
            for k in sorted(by):
                rows.append(i)
                text.append(b" ".join(w for lo, hi in sorted(by[k]) for w in words[lo:hi]).decode())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(text, pa.string())], names=["row", "mixed"])


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """docs as the mix has them, with the columns of docs: for each pass that takes words of a document a row with
    those words, joined by single spaces. Documents of which nothing is taken are gone. Cases: as in mixed()."""
    _, _, taken = _drawn(docs, block, seed, shard)
    start = F.col("block") * block - F.col("off")
    named = F.coalesce("doc_id", F.lit(-1 << 63)).alias("id")
    takes = taken.select(named, "th", F.struct("turn", "off", (start + F.col("a")).alias("lo"), (start + F.col("b")).alias("hi")).alias("x"))
    takes = takes.groupBy("id", "th").agg(F.collect_list("x").alias("takes"))
    # equal ids and texts have one list of takes between them; grouping and join have the same keys, so that texts are shuffled once
    once = keyed(docs).select(named, "th", "row").groupBy("id", "th").agg(F.first("row").alias("row"))
    both = once.join(takes, ["id", "th"]).select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "takes")
    out = both.mapInArrow(_words, StructType([both.schema["row"], StructField("mixed", StringType())]))
    return unpacked(out, docs, F.col("mixed"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, sid, block, turn, off, part): the words of a document that a slot takes."""
    for b in batches:
        for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = text.encode().split()
            for i in range(0, len(cuts), 4096):
                some = cuts[i : i + 4096]
                part = [b" ".join(words[c["lo"] : c["hi"]]).decode() for c in some]
                names = ["shard", "sid", "block", "turn", "off"]
                yield pa.RecordBatch.from_arrays([*(pa.array([c[k] for c in some], pa.int64()) for k in names), pa.array(part, pa.string())], names=[*names, "part"])


def packed(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(shard, sid, block, turn, text): the words of each slot of the output shards. Cases: as in mixed()."""
    _, _, taken = _drawn(docs, block, seed, shard)
    start = F.col("block") * block - F.col("off")
    named = F.coalesce("doc_id", F.lit(-1 << 63)).alias("id")
    cuts = taken.select(named, "th", F.struct("shard", "sid", "block", "turn", "off", (start + F.col("a")).alias("lo"), (start + F.col("b")).alias("hi")).alias("x"))
    cuts = cuts.groupBy("id", "th").agg(F.collect_list("x").alias("cuts"))
    once = keyed(docs).select(named, "th", "text").groupBy("id", "th").agg(F.first("text").alias("text"))
    parts = once.join(cuts, ["id", "th"]).select("text", "cuts").mapInArrow(_parts, "shard long, sid long, block long, turn long, off long, part string")
    return parts.groupBy("shard", "sid", "block", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "part"))), lambda p: p.part), " ").alias("text"))
