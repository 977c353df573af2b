from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rolloom.llm import near_dedup as nd


def linked(a, b):
    q = min(len(a), len(b))
    return q > 0 and len(a & b) >= nd.CONTAINMENT * q - 1e-9


def similar(a, b):
    return min(len(a), len(b)) >= nd.RATIO * max(len(a), len(b))


def brute(rows, parts=True):
    """For each row: (group of its near copies, number of links at any ratio, is it in a larger one), and the sets."""
    h, off = nd.shingles(pa.array([t or "" for _, t in rows]))
    sets = [frozenset(h[off[k] : off[k + 1]].tolist()) for k in range(len(rows))]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links, part = [0] * len(rows), [False] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or linked(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                if same or similar(sets[a], sets[b]):
                    ra, rb = root(a), root(b)
                    up[max(ra, rb)] = min(ra, rb)
                else:
                    part[min(a, b, key=lambda k: len(sets[k]))] = True
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    return list(groups.values()), links, part, sets


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60, 150, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: int(len(copy) * rng.choice([1, 1, 0.8]))])))
        for _ in range(rng.choice([0, 0, 1])):
            at = rng.randrange(len(words))
            rows.append((len(rows), " ".join(words[at : at + rng.randint(3, 60)])))
    return rows


def by_row(got, rows):
    """The results in the order of rows."""
    at = {}
    for r in got:
        assert at.setdefault((r.doc_id, r.th), r) == r
    return at


def test_equals_brute_force(spark, docs):
    rows = make(1)
    rows += [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, two!"), (5005, "long text " * 20_000), (5006, "long text " * 20_000), (None, rows[0][1]), (None, "no id at all here my friends"), (3, rows[3][1]), (3, "the same id with another text"), (2, rows[0][1])]
    got = nd.link(docs(rows)).collect()
    assert len(got) == len(rows)
    groups, links, part, sets = brute(rows)
    at = by_row(got, rows)
    hashes = [r[0] for r in spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string").orderBy("k").select(F.xxhash64("t")).collect()]
    mine = [at[(i, h)] for (i, _), h in zip(rows, hashes)]
    assert [r.n_links for r in mine] == links
    assert [r.part_of is not None for r in mine] == part and any(part)
    for g in groups:
        ids = [rows[k][0] for k in g if rows[k][0] is not None]
        assert {mine[k].component_id for k in g} == {min(ids, default=None)}, [rows[k] for k in g]
        free = [k for k in g if not (part[k] and len(sets[k]) >= nd.PART)]
        kept = {(rows[k][0], rows[k][1]) for k in g if mine[k].kept}
        assert len(kept) == (1 if free else 0)
        assert all(len(sets[k]) == max(len(sets[f]) for f in free) for k in g if mine[k].kept)
    out = nd.one_of_each(docs(rows)).collect()
    assert len(out) == len(groups) and all(r.row == f"row{r.doc_id}" for r in out if r.doc_id is not None)


def test_empty(docs):
    assert nd.link(docs([])).count() == 0 and nd.one_of_each(docs([])).count() == 0
    assert [r.n_links for r in nd.link(docs([(1, None), (2, "a")])).collect()] == [0, 0]


def test_passages_of_any_share_are_found(docs):
    """Recall of links by size ratio, against brute force without a cut, at and above the threshold."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([300, 1000, 3000]))]
        rows.append((len(rows), " ".join(words)))
        for share in (0.5, 0.4, 0.25, 0.1, 0.03, 0.01, 0.003):
            n = max(3, int(len(words) * share))
            at = rng.randrange(len(words) - n)
            copy = words[at : at + n]
            for _ in range(int(n * rng.choice([0, 0.03, 0.08]))):
                copy[rng.randrange(n)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    _, links, part, sets = brute(rows)
    found, there = defaultdict(int), defaultdict(int)
    got = {r.doc_id: r for r in nd.link(docs(rows)).collect()}
    for i, (n, p) in enumerate(zip(links, part)):
        band = round(-math.log2(len(sets[i]) / max(len(sets[i // 8 * 8]), 1)))
        there[band] += n
        found[band] += got[i].n_links
        assert got[i].n_links <= n and (got[i].part_of is None or p)
    assert all(found[b] >= 0.98 * there[b] for b in there), (found, there)
    assert sum(there.values()) > 500


def test_boilerplate_does_not_link(docs):
    rng = random.Random(5)
    shared = " ".join(f"b{i}" for i in range(12))
    rows = [(i, shared + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(150)] + [(1000, shared)]
    got = {r.doc_id: r for r in nd.link(docs(rows)).collect()}
    assert got[1000].n_links == 150 and not got[1000].kept and got[1000].part_of is not None
    assert all(r.n_links == 1 and r.kept and r.component_id == i for i, r in got.items() if i < 1000)
    assert len(nd.one_of_each(docs(rows)).collect()) == 151


def test_tuning():
    bands = [nd.tuned(d) for d in range(5)]
    assert bands == sorted(bands) and len(set(bands)) > 2 and bands[-1] * nd.ROWS <= nd.HASHES
    for d, n in enumerate(bands):
        s = nd.jaccard(min(1 / nd.RATIO, 2 ** ((d + 1) / nd.STEPS)), nd.CONTAINMENT)
        assert (1 - s**nd.ROWS) ** n <= nd.MISS * 1.1
        c = nd.least_bands(s, n, nd.ROWS, nd.MISS / 2)
        hits = np.random.default_rng(d).binomial(n, s**nd.ROWS, 200_000)
        assert (hits < c).mean() <= nd.MISS * 1.1
    sizes = np.arange(1, 5000)
    part = nd.partition(sizes)
    assert all(nd.bound(int(p)) <= n < nd.bound(int(p) + 1) or nd.bound(int(p)) == nd.bound(int(p) + 1) for n, p in zip(sizes, part))


def test_lookups_suffice():
    """Any linked set has one of the values looked up: always for small sets, but for a small share for larger ones."""
    for n in range(1, nd.LOW + 1):
        assert nd.looked_up(n) + math.ceil(nd.CONTAINMENT * n - 1e-9) == n + 1
    have = np.random.default_rng(1).binomial(nd.SAMPLE, nd.CONTAINMENT, 1_000_000)
    assert (have < nd.FOUND).mean() < 5e-4 and nd.looked_up(nd.LOW + 1) + nd.FOUND == nd.SAMPLE + 1


def test_counts_all_links(docs):
    """Groups of many near copies: each document counts all that it links with, also across blocks."""
    rng = random.Random(7)
    rows = []
    for _ in range(3):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(20):
            copy = list(words)
            for _ in range(rng.choice([1, 2, 4, 6])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    want = {i: n for (i, _), n in zip(rows, brute(rows)[1])}
    assert max(want.values()) >= 19
    for how in ({}, {"block": 6}):
        assert {r.doc_id: r.n_links for r in nd.link(docs(rows), **how).collect()} == want


def test_no_pair_at_the_threshold_is_left_out(docs):
    """Pairs of 10 and 20 shingles that share 7: linked, but neither bands nor samples find each of so many."""
    rows = []
    for k in range(2000):
        words = [f"w{k}x{i}" for i in range(12)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:9] + [f"v{k}x{i}" for i in range(13)])))
    _, links, part, _ = brute(rows[:20])
    assert links == [1] * 20 and not any(part)
    assert {r.doc_id for r in nd.one_of_each(docs(rows)).collect()} == {2 * k + 1 for k in range(2000)}


def test_links_are_summed_where_sets_meet(docs):
    """Short texts that stand in all others: as many links as pairs, but no row for each of them is written."""
    rng = random.Random(9)
    shared = " ".join(f"b{i}" for i in range(16))
    rows = [(i, shared + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, shared + f" y{i}") for i in range(30)]
    _, links, part, _ = brute(rows)
    assert sum(links) / 2 > 9000
    got = {r.doc_id: r for r in nd.link(docs(rows)).collect()}
    assert [got[i].n_links for i, _ in rows] == links and [got[i].part_of is not None for i, _ in rows] == part
    assert nd._Index(docs(rows), nd.CONTAINMENT, nd.RATIO, nd.WORDS).links(0.0, nd.BLOCK).count() < 2 * len(rows)


def test_a_common_phrase_is_no_candidate(docs):
    """Large sets that share a phrase only aren't sent to where sets are compared, close copies are."""
    rng = random.Random(3)
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(200)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:-1] + ["end", "of", "it"]))]
        at = rng.randrange(190)
        rows.append((3 * k + 2, " ".join([f"v{k}x{i}" for i in range(600)] + words[at : at + 6])))
    pairs, _ = nd._Index(docs(rows), nd.CONTAINMENT, nd.RATIO, nd.WORDS).candidates(0.0)
    assert pairs.select(F.sum(F.size("us"))).first()[0] == 30
