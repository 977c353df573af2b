"""Operator 3: cross-site boilerplate lines, by HyperLogLog sketches of the sites of each line.

A sketch has REGISTERS registers. Each holds its ranks as a bit set of 16, four registers to a 64-bit column, so
that sketches merge by bitwise or inside the hash aggregation of Spark, within partitions first; the largest rank
is HyperLogLog's register. No site is counted twice, and n occupied registers need n sites at least, so that
many lines are decided by the sketch; all others that stand there often enough get an exact distinct count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import keyed, small, stored, unpacked

#: A line on so many sites is boilerplate.
MIN_SITES = 8
REGISTERS, RANKS = 32, 16
#: Copies of a table of boilerplate lines that is too large to broadcast, so that no line's occurrences meet in one task.
SALT = 16


def _sketch(site: Column) -> list[Column]:
    """The columns that add one site, to be merged by bit_or."""
    register = site.bitwiseAND(F.lit(REGISTERS - 1))
    tail = F.shiftrightunsigned(site, int(math.log2(REGISTERS)))
    # the rank: how many zeros the hash ends in, 15 at most
    rank = F.least(F.bit_count((tail.bitwiseAND(-tail)) - F.lit(1)), F.lit(RANKS - 1))
    rank = F.when(tail == 0, RANKS - 1).otherwise(rank)
    per = 64 // RANKS
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((register % per) * RANKS).cast("int") + rank.cast("int"))
    return [F.when((register / per).cast("int") == i, bit).otherwise(F.lit(0).cast("long")) for i in range(REGISTERS // per)]


def _registers(columns: list[Column]) -> Column:
    """The highest rank of each register, plus one; 0 if it is empty."""
    out = []
    for c in columns:
        for j in range(64 // RANKS):
            word = F.shiftrightunsigned(c, j * RANKS).bitwiseAND(F.lit((1 << RANKS) - 1))
            out.append(F.when(word == 0, 0).otherwise(F.floor(F.log2(word.cast("double")) + 1e-9).cast("int") + 1))
    return F.array(*out)


def estimate(registers: Column) -> Column:
    m = REGISTERS
    empty = F.size(F.filter(registers, lambda r: r == 0))
    raw = F.lit(0.697 * m * m) / F.aggregate(registers, F.lit(0.0), lambda a, r: a + F.pow(F.lit(2.0), -r))
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty)).otherwise(raw)


def _lines(docs: DataFrame, positions: bool) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))).alias("site"), *([F.xxhash64(text).alias("th")] if positions else []), F.split(text, "\n").alias("lines"))
    out = base.select(*[c for c in base.columns if c != "lines"], F.posexplode("lines").alias("at", "line") if positions else F.explode("lines").alias("line"))
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    return out.withColumn("line", line).filter("line <> ''").select(*[c for c in out.columns if c != "line"], F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first, sites): hashes of the lines on at least min_sites sites, the smallest doc_id that has it, and
    the number of sites: exact where it was counted, else the sketch's estimate. Which lines these are is exact."""
    lines = _lines(docs, False)
    parts = [f"s{i}" for i in range(REGISTERS * RANKS // 64)]
    marked = lines.select("doc_id", "h1", "h2", *(c.alias(p) for p, c in zip(parts, _sketch(F.col("site")))))
    merged = marked.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), *(F.bit_or(p).alias(p) for p in parts)).filter(F.col("n") >= min_sites)
    merged = merged.withColumn("r", _registers([F.col(p) for p in parts])).select("h1", "h2", "first", F.size(F.filter("r", lambda r: r > 0)).alias("taken"), estimate(F.col("r")).alias("guess"))
    merged = stored(merged.withColumn("sure", F.col("taken") >= min_sites))
    near = merged.filter("not sure").select("h1", "h2", "first")
    if near.isEmpty():
        exact = near.withColumn("sites", F.lit(None).cast("long"))
    else:
        exact = _beside(lines, stored(near)).groupBy("h1", "h2", "first", "site").count().groupBy("h1", "h2", "first").agg(F.count("*").alias("sites"))
    sure = merged.filter("sure").select("h1", "h2", "first", F.round("guess").cast("long").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites))


def _beside(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """lines with the columns of a stored table of (h1, h2): broadcast if it is small, else copied for each salt, as the
    lines in it are the frequent ones."""
    side = small(chosen)
    if side is not chosen:
        return lines.join(side, ["h1", "h2"])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(chosen.withColumn("salt", salts), ["h1", "h2", "salt"]).drop("salt")


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """(row, doc_id, _gone): the rows of docs as structs, with the positions of the lines to remove, null if there are none."""
    found = stored(boilerplate(docs, min_sites).select("h1", "h2", "first"))
    hits = _beside(_lines(docs, True), found).filter(F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    hits = hits.groupBy("doc_id", "th").agg(F.collect_set("at").alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_gone")
    hits = small(stored(hits))
    rows = keyed(docs).select("row", "doc_id", "th")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("row", "doc_id", "_gone")


def _text() -> Column:
    return F.coalesce(F.col("row.text").cast("string"), F.lit(""))


def _kept() -> Column:
    return F.when(F.col("_gone").isNull(), _text()).otherwise(F.array_join(F.filter(F.split(_text(), "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with its columns, texts without the lines that stand on min_sites sites or more.

    Lines are compared without white space around them; blank ones stay. A boilerplate line stays in the document
    with the smallest doc_id that has it, so that no content is lost altogether. Null text stays null. Null
    source: a site of its own. Null doc_id: never the first; if no document with the line has an id, it stays.
    Repeated rows: equal results. Empty table: no rows. A text that loses all lines is empty, its row stays. If
    there is a column n_chars, it is brought up to date where lines went.
    """
    out = _marked(docs, min_sites)
    same, cut = out.filter("_gone is null"), out.filter("_gone is not null")
    return unpacked(same, docs).unionByName(unpacked(cut, docs, _kept()))


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256), a row for each row of docs; null text: as empty."""
    out = _marked(docs, min_sites)
    return out.select("doc_id", F.size(F.split(_text(), "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(_kept(), 256).alias("kept_sha256"))
