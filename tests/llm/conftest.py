from __future__ import annotations

import pytest

#: Names that the operators use inside, so that they clash if an operator doesn't keep them apart.
EXTRA = ("th", "size", "key", "row", "n", "takes", "digest", "block", "at", "host", "bucket", "label", "_gone", "_id", "line")


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table like documents, with extra columns, from (doc_id, text, lang, source)."""

    def make(rows, extra=True):
        rows = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for c in EXTRA:
                df = df.selectExpr("*", f"concat('{c}', cast(doc_id as string)) as `{c}`")
        return df.repartition(3) if rows else df

    return make
