from __future__ import annotations

import re

from rolloom.llm import license_scan as ls


def brute(text):
    fold = lambda t: re.sub(r"[^a-z0-9]+", " ", t.encode().decode("ascii", "replace").lower()).split()
    grams = lambda t: set(zip(fold(t), fold(t)[1:]))
    units = [text]
    for parts in (re.split(r"\n[ \t\r]*\n", text), text.split("\n")):
        units += parts if len(parts) > 1 else []
    found = []
    for u in units:
        a = grams(u)
        scores = sorted((-2 * len(a & grams(t)) / (len(a) + len(grams(t))), name) for name, t in ls.TEMPLATES)
        if -scores[0][0] >= ls.THRESHOLD:
            found.append((scores[0][0], scores[0][1]))
    if not found:
        return 0, None, None, ""
    best = min(found)
    return len(found), best[1], -best[0], ",".join(sorted({n for _, n in found}))


def test_equals_brute_force(docs):
    rows = [(i, f"Some words.\n{t}\nAnd more.") for i, (_, t) in enumerate(ls.TEMPLATES)]
    rows += [(100 + i, t.upper().replace(" ", "  ")) for i, (_, t) in enumerate(ls.TEMPLATES)]
    rows += [(200, "Released under the MIT Licence."), (201, "the MIT License is good"), (202, "All rights reserved.\n\nReleased under the\nMIT License."), (300, None), (301, ""), (302, "x"), (None, "Licensed under CC BY 4.0."), (304, "word " * 50_000 + "\nReleased under the MIT License."), (305, "released under the mit license " * 3000), (200, "Released under the MIT Licence.")]
    got = ls.scan(docs(rows)).collect()
    want = sorted((str(i), *brute(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_matches, r.license, r.score, r.licenses) for r in got) == want
    assert ls.scan(docs([])).count() == 0
