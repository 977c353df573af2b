from __future__ import annotations

from rolloom.llm import langid
from rolloom.llm.queries import QUERIES


def corpus():
    en = "the quick and the dead were with those that would not be there when it was time for the others to see what had been done"
    de = "und die anderen sind nicht mit den sachen die wir noch nicht gesehen haben weil das wetter schlecht war und niemand kam"
    rows = []
    for i in range(60):
        w, lang = (en.split(), "en") if i % 2 else (de.split(), "de")
        rows.append((i, " ".join(w[(i * 7 + k) % len(w)] for k in range(25)), lang, "en.example" if i % 2 else "de.example"))
    return rows


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1")
    got = langid.identify(held.withColumnRenamed("lang", "truth"), declared=None, host=None, model=model)
    truth = {r.doc_id: r.lang for r in held.select("doc_id", "lang").collect()}
    rows = got.collect()
    assert sum(truth[r.doc_id] == r.language for r in rows) >= 0.97 * len(rows)


def test_evidence_is_fused(docs):
    rows = corpus()
    doubtful = [(900, "xx xx", None, "en.example"), (901, "xx xx", None, "de.example"), (902, "xx xx", "de", "other.example"), (903, "xx xx", "en", "other.example")]
    got = {r.doc_id: r for r in langid.identify(docs(rows + doubtful)).collect()}
    assert all(got[i].language == lang for i, _, lang, _ in rows)
    assert [got[i].language for i in (900, 901, 902, 903)] == ["en", "de", "de", "en"]


def test_cases(docs):
    rows = corpus() + [(500, None, "en", "x"), (501, "", "en", "x"), (502, "12 34 !!", "en", "x"), (None, corpus()[0][1], None, None), (504, "the " * 300_000, "en", None), (0, corpus()[0][1], "de", "de.example")]
    df = docs(rows)
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].language == "und" and not by[i].kept for i in (500, 501, 502)) and by[504].language == "en" and by[None].language == "de"
    out = langid.in_language(df).collect()
    assert len(out) == len(rows) - 3 and all(r.host == f"host{r.doc_id}" for r in out if r.doc_id is not None)
    assert langid.identify(docs([])).count() == 0 and langid.in_language(docs([])).count() == 0
    unlabelled = docs([(1, "some text", None, "a")])
    assert [r.kept for r in langid.identify(unlabelled).collect()] == [False] and langid.in_language(unlabelled).count() == 1


def test_labels_are_normalised_and_none_is_dropped(docs):
    rows = [(i, t, {"en": "EN", "de": "de-AT"}[lang] if i % 3 else lang, s) for i, t, lang, s in corpus()]
    rows += [(1000 + i, f"zz{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i}", "x") for i in range(90)]
    model = langid.train(docs(rows))
    assert len(model.languages) == 92 and {"en", "de"} <= set(model.languages)
    assert all(t.size <= langid.MODEL_CELLS for t in model.tables)
    got = {r.doc_id: r.language for r in langid.identify(docs(rows), model=model).collect()}
    assert all(got[i] == lang for i, _, lang, _ in corpus())


def test_posterior_equals_brute_force(docs):
    import math

    import numpy as np
    import pyarrow as pa

    df = docs(corpus())
    model = langid.train(df)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    th = {r.doc_id: r.th for r in langid.identify(df, model=model).collect()}
    n, mean = model.scores(pa.array([r[1] for r in rows]), np.array([th[r[0]] for r in rows]))
    guess = mean.argmax(axis=1)
    got = {r.doc_id: r.posterior for r in langid.identify(df, model=model, reliable=0.9).collect()}
    for k, (i, _, lang, source) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != k]
        prior = np.array([(sum(guess[j] == c for j in others) + 1) / (len(others) + 2) for c in range(2)])
        for level in (others, [j for j in others if rows[j][3] == source]):
            prior = np.array([(sum(guess[j] == c for j in level) + langid.SMOOTHING * prior[c]) / (len(level) + langid.SMOOTHING) for c in range(2)])
        log = np.float32(mean[k] * n[k] / langid.OVERLAP) + np.log(prior) + np.log([0.9 if model.languages[c] == lang else 0.1 for c in range(2)])
        p = np.exp(log - log.max())
        assert math.isclose(got[i], p.max() / p.sum(), rel_tol=1e-6)


def test_pages(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["op4_language_id_pages"](spark, d).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert len(got) == len(html) and sum(f'lang="{r.language}"' in html[r.page_id] for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, None), (2, "no url", "<p>x"), (None, "https://a.fr/x", "<html lang=fr><script>a<b</script>le chat")], "page_id long, url string, html string")
    assert langid.of_pages(odd).count() == 3
    twice = odd.union(odd).selectExpr("*", "'x' as th", "1 as host", "'y' as language")
    assert langid.of_pages(twice).count() == 6 and langid.of_pages(odd.limit(0)).count() == 0
