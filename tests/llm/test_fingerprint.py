from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from rolloom.llm import fingerprint as fp


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    return [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(n)]


def test_collisions_estimate_generalised_jaccard():
    a = texts(300)
    rng = random.Random(2)
    b = [" ".join(x.split()[: int(len(x.split()) * rng.random())] + y.split()[:80]) for x, y in zip(a, a[1:] + a[:1])]
    got = fp.likeness(fp.fingerprints(pa.array(a)), fp.fingerprints(pa.array(b)))
    want = np.array([jaccard(x, y) for x, y in zip(a, b)])
    assert np.sqrt(((got - want) ** 2).mean()) < 0.06 and abs((got - want).mean()) < 0.03


def test_cases(docs):
    t = texts(120)
    rows = [(i * 3, x) for i, x in enumerate(t)] + [(1, None), (2, ""), (4, "  \n "), (5, "é" * 7), (7, t[0]), (7, t[0]), (None, "no id"), (8, "word " * 60_000)]
    df = docs(rows)
    got = fp.fingerprint(df, texts=True).collect()
    assert len(got) == len(rows)
    order = sorted(((i if i is not None else 1 << 62), x or "") for i, x in rows)
    want = Counter()
    for k, (i, x) in enumerate(order):
        y = order[(k + 1) % len(order)][1]
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        want[(None if i == 1 << 62 else i, len(x), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = {i: x or "" for i, x in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        alone = fp.fingerprints(pa.array([text[r.doc_id], r.edited]))
        assert [x.astype(">u2").tobytes().hex() for x in alone] == [r.fingerprint, r.edited_fingerprint]
        assert r.near_edited == fp.likeness(alone[:1], alone[1:])[0] and 0 <= r.near_next <= 1


def test_one_and_none(docs):
    r = fp.fingerprint(docs([(5, "a b c d")])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fp.fingerprint(docs([])).count() == 0
