from __future__ import annotations

import math

import numpy as np
import pytest

from rolloom.llm import embed_dedup


def brute(rows):
    def ok(i, x, label):
        return i is not None and label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)

    links = {k: set() for k in range(len(rows))}
    for a, (i, x, p) in enumerate(rows):
        for b, (j, y, q) in enumerate(rows):
            if a < b and ok(i, x, p) and ok(j, y, q) and p == q and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= 0.93:
                    links[a].add(b), links[b].add(a)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b), todo.append(b)
        c = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), c, i == c))
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' as key", "'y' as n", "'z' as digest", "1.5 as chunk").repartition(3) if rows else df


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(150):
        x = rng.standard_normal(16)
        rows.append((len(rows), [float(v) for v in x.astype("f4")], int(i % 3)))
        for _ in range(int(rng.integers(0, 4))):
            y = x + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.45])
            rows.append((len(rows), [float(v) for v in y.astype("f4")], int(i % 3)))
    same = [1.0] + [0.0] * 15
    rows += [(1000 + k, same, 1) for k in range(30)] + [(2000, [2.0] + [0.0] * 15, 1), (1001, same, 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] + [1.0] * 15, 1), (3005, [float("inf")] + [1.0] * 15, 1), (3006, same, None), (3007, same[:8], 1), (None, same, 1)]
    near, far = [1.0, 0.1] + [0.0] * 14, [0.0] * 15 + [1.0]
    rows += [(4000, same, 2), (4000, far, 2), (4001, near, 2), (4002, far[:14] + [0.1, 1.0], 2), (4003, far, 2)]  # one id, two vectors
    got = sorted((tuple(r) for r in embed_dedup.link(table(spark, rows), block=block).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    # rows without an id: kept, as no id is smaller
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]


def test_empty(spark):
    assert embed_dedup.link(table(spark, [])).count() == 0


def test_tables_follow_the_size():
    for n in (10, 10_000, 10_000_000):
        bits, tables = embed_dedup.plan(n)
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - p) ** tables <= embed_dedup.MISS


def test_rounding_is_bounded():
    x = embed_dedup.unit([np.random.default_rng(k).standard_normal(64).tobytes() for k in range(200)])
    y, off = embed_dedup.unrounded(embed_dedup.rounded(x))
    assert (np.linalg.norm(x - y, axis=1) <= off).all() and off.max() < 0.02
    p, q = off[:, None], off
    assert (np.abs(x @ x.T - y @ y.T) <= p + q + p * q).all()
