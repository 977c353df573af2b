from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from rolloom.llm import pii
from rolloom.llm.queries import QUERIES


def brute(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        alphabet = rng.choice(["ab@.-1", "0123456789 -", "1234567890.", "+12345 ().-", "a@b.é 4111-+"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 500_000, "1" * 500_000, "@a" * 200_000, "+1(" * 200_000, "1.2." * 100_000):
        pii.base_spans(t)


def test_cases(docs):
    text = "écrire à Ann.B@mail.example.org ou +1 (555) 123-4567, 10.0.0.256, 10.0.0.25 et 4111 1111 1111 1111."
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "nothing"), (5, "a" * 200_000)]
    got = pii.digest(pii.find(docs(rows))).collect()
    assert len(got) == len(rows)
    want = pii.joined(brute(text))
    for r in got:
        if r.doc_id in (1, None):
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want  # one text is no evidence
        else:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.digest(pii.find(docs([]))).count() == 0


def disclosed(rows, generalise_at=pii.GENERALISE_AT, remove_at=pii.REMOVE_AT, support=pii.SUPPORT):
    """All spans of each row, by counting every pair of term and entity in every document."""
    docs, df, df_e, both = [], Counter(), Counter(), defaultdict(list)
    for _, t in rows:
        t = t or ""
        spans = brute(t)
        words = [(m.start(), m.end(), "".join(c.lower() if c.isascii() else c for c in m[0])) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t)]
        free = [w for w in words if not any(w[0] < e and s < w[1] for s, _, e in spans)]
        names = {t[s:e].lower() for s, _, e in spans}
        docs.append((t, spans, free, names))
        df.update({w for _, _, w in words})
        df_e.update(names)
        for e in names:
            both[e, None].append(t)
            for w in {w for _, _, w in free}:
                both[e, w].append(t)
    kind = {}
    for (e, w), texts in both.items():
        worth = math.log(len(rows) / df_e[e])
        if w is None or len(set(texts)) < support or worth <= 0:
            continue
        told = math.log(len(rows) * len(texts) / (df[w] * df_e[e])) / worth
        if told >= generalise_at:
            kind[e, w] = 5 if told >= remove_at else 4
    most = lambda w, names: max((kind.get((e, w), 0) for e in names), default=0)
    return [pii.joined(sorted(spans + [(s, most(w, names), e) for s, e, w in free if most(w, names)])) for _, spans, free, names in docs]


def test_added_spans_equal_brute_force(docs):
    rng = random.Random(9)
    people = [(f"p{k}@mail.org", f"+49 30 1234 56{k:02d}", [f"Nym{k}", f"{k}77", "Straße" + "é" * k]) for k in range(12)]
    common = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(500):
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        for mail, phone, tells in rng.sample(people, rng.choice([0, 0, 1, 2])):
            if rng.random() < 0.6:
                words.insert(rng.randrange(len(words)), rng.choice([mail, phone]))
            for t in tells:
                if rng.random() < 0.7:
                    words.insert(rng.randrange(len(words)), t)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i][1]) for i in range(5)] + [(900, None), (901, ""), (None, rows[7][1])]
    df = docs(rows)
    want = disclosed(rows)
    assert sum("removed" in w or "general" in w for w in want) > 20
    for how in ({}, {"generalise_at": 0.5, "remove_at": 0.6, "support": 3}):
        got = pii.digest(pii.find(df, **how)).collect()
        assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), w) for (i, _), w in zip(rows, disclosed(rows, **how)))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("@mail.org" not in (t or "") for t in clean.values())
    assert all(t == dict(rows)[i] for i, t in clean.items() if i is not None and not brute(dict(rows)[i] or ""))  # nothing to protect


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op1_pii"](spark, d).collect():
        want = pii.joined(brute(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))
