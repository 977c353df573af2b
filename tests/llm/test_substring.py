from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from rolloom.llm import substring


def brute(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i].append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def rows_with_repeats(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30))
    shared = [" ".join(word() for _ in range(rng.randint(13, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(200, rows[5][1]), (201, rows[5][1].replace("\n", " ")), (201, rows[5][1].replace("\n", " ")), (300, "x " * 5000), (301, "x " * 40), (302, None), (303, ""), (304, "a b c"), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize("group", [substring.GROUP, 3])
def test_equals_brute_force(docs, group):
    rows = rows_with_repeats(group)
    got = defaultdict(list)
    for r in substring.remove_repeats(docs(rows), texts=True, group=group).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert {k: sorted(v) for k, v in got.items()} == brute(rows)


def test_empty(docs):
    assert substring.remove_repeats(docs([])).count() == 0 and substring.passages(docs([])).count() == 0


def test_one_id_with_different_texts(docs):
    w = [f"w{k}" for k in range(300)]
    texts = [(1, w[:40]), (7, w[:20] + w[100:155]), (7, w[200:240] + w[:20]), (9, w[110:150]), (9, w[205:235] + w[60:70])]
    rows = [(i, " ".join(x)) for i, x in texts]
    got = defaultdict(list)
    for r in substring.remove_repeats(docs(rows)).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows)


def test_very_long_texts(docs):
    rows = [(1, "x " * 2_000_000), (2, "y " + "x " * 1_000_000), (3, "y " * 12), (4, "y " + "x " * 12)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs(rows)).collect()}
    assert got == {1: (2_000_000, 0), 2: (1_000_001, 1_000_000), 3: (12, 0), 4: (13, 13)}


@pytest.mark.parametrize("group", [substring.GROUP, 3])
def test_maximal_passages(docs, group):
    rows = [r for r in rows_with_repeats(5) if r[0] is not None and r[0] < 200]
    first, want = {}, set()
    for i, t in rows:
        w = t.split()
        hit = [first.setdefault(tuple(w[k : k + 13]), i) < i for k in range(len(w) - 12)] + [False]
        start = None
        for k, h in enumerate(hit):
            if h and start is None:
                start = k
            elif not h and start is not None:
                want.add((i, start, k + 12))
                start = None
    assert {(r.doc_id, r.start, r.end) for r in substring.passages(docs(rows), group).collect()} == want and want


def test_tree():
    s = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [0, 9, 9]], "<u8")
    order, common = substring.tree(s)
    assert [tuple(s[i]) for i in order] == sorted(map(tuple, s.tolist())) and common.tolist() == [0, 0, 3, 2]
