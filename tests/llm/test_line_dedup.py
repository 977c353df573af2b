from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rolloom.llm import line_dedup


def brute(rows, least):
    sites, first = {}, {}
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\r")
            sites.setdefault(k, set()).add(s)
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t, _, s in rows:
        lines = (t or "").split("\n")
        gone = [bool(k) and len(sites[k]) >= least and k in first and first[k] != i for k in (x.strip(" \t\r") for x in lines)]
        out.append((str(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_equals_brute_force(docs, least):
    rows = [(i, f"own line {i}\n  menu \n" + "\n".join(f"spread {k}" for k in range(1, 13) if i % 13 < k) + "\n\nend\t", "en", f"s{i % 13}") for i in range(80)]
    rows += [(500, None, "en", "s1"), (501, "", "en", "s2"), (502, "menu", "en", None), (None, "menu\nspread 12\nonly here", "en", "s3"), (3, rows[3][1], "en", "s3"), (600, "long " * 50_000 + "\nmenu", "en", "s4")]
    df = docs(rows)
    got = {}
    want = brute(rows, least)
    digest = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.digest(df, least).collect())
    assert digest == sorted((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in want)
    out = line_dedup.remove_boilerplate(df, least).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted((i, t) for i, _, _, t in want)
    assert all(r.key == f"key{r.doc_id}" for r in out if r.doc_id is not None) and {r.doc_id: r.text for r in out}[500] is None
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    del got


def test_empty(docs):
    assert line_dedup.digest(docs([])).count() == 0 and line_dedup.remove_boilerplate(docs([])).count() == 0


def test_sketches_merge_and_estimate(spark):
    parts = [f"s{i}" for i in range(line_dedup.REGISTERS * line_dedup.RANKS // 64)]
    sites = spark.range(5000).select((F.col("id") % 5 + 1).alias("g"), F.xxhash64("id").alias("site"), "id")
    sites = sites.filter(F.col("id") < F.pow(F.lit(6.0), F.col("g")))  # about a fifth of 6, 36, 216, 1296 and 5000 sites
    sites = sites.union(sites)
    marked = sites.select("g", "site", *(c.alias(p) for p, c in zip(parts, line_dedup._sketch(F.col("site")))))
    got = marked.groupBy("g").agg(F.count_distinct("site").alias("n"), *(F.bit_or(p).alias(p) for p in parts)).withColumn("r", line_dedup._registers([F.col(p) for p in parts]))
    for r in got.select("g", "n", line_dedup.estimate(F.col("r")).alias("e"), F.size(F.filter("r", lambda x: x > 0)).alias("taken")).collect():
        assert abs(r.e - r.n) <= max(2, 0.6 * r.n) and r.taken <= r.n
