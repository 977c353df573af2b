from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rolloom.domains.math_problems import number
from rolloom.functions import columns as C
from rolloom.operators.transition import stable_id


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_ids_equal_python(spark):
    assert one(spark, C.stable_id("a", F.lit(7), F.lit(None))) == stable_id("a", 7, None) == hashlib.sha256(b"a|7|None").hexdigest()[:12]


@pytest.mark.parametrize(("x", "want"), [(-1.0, 0.0), (0.3, 0.3), (7.0, 1.0), (float("nan"), 1.0), (None, None)])
def test_clamp(spark, x, want):
    assert one(spark, C.clamp(F.lit(x).cast("double"))) == want


def test_means_are_rounded_once(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert df.agg(C.exact_mean("x")).first()[0] == 0.2
    assert df.filter("x > 1").agg(C.exact_mean("x")).first()[0] == 0.0


def test_fixed_is_exact_half_even(spark):
    assert one(spark, C.fixed(F.lit(0.6675))) == "0.667" == f"{0.6675:.3f}"
    assert one(spark, C.rounded(F.lit(0.12345), 4)) == round(0.12345, 4)


@pytest.mark.parametrize(("x", "want"), [("3", 3), ("99", 7), ("-4", 1), ("2.9", 2), ("heavy", 1), (None, 1)])
def test_weights(spark, x, want):
    assert one(spark, C.weight(F.lit(x).cast("string"), 7)) == want


def test_texts(spark):
    assert one(spark, C.bullets(F.array(F.lit("ab"), F.lit("cd")), 1)) == "- a\n- c"
    assert one(spark, C.bullets(F.lit(None).cast("array<string>"))) == "(none)"
    assert one(spark, C.provider(F.lit("a/b/c"))) == "a" and one(spark, C.model_name(F.lit("a/b/c"))) == "b/c"
    assert one(spark, C.provider(F.lit("x"))) == one(spark, C.model_name(F.lit("x"))) == "x"
    assert one(spark, C.peek_round(F.lit("see ROUND: 12."))) == 12 and one(spark, C.peek_round(F.lit("no"))) == 1
    assert one(spark, C.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, C.unfenced(F.lit("plain"))) == "plain"


def messages(*pairs):
    return F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in pairs))


def test_rules(spark):
    rules = F.array(F.lit("one"), F.lit("two"))
    got = one(spark, C.with_rules(messages(("system", "s"), ("user", "u")), rules))
    assert [tuple(m) for m in got] == [("system", "s\n\nFurther rules:\n- one\n- two"), ("user", "u")]
    got = one(spark, C.with_rules(messages(("user", "u")), rules))
    assert [tuple(m) for m in got] == [("system", "Further rules:\n- one\n- two"), ("user", "u")]
    assert len(one(spark, C.with_rules(messages(("user", "u")), F.array().cast("array<string>")))) == 1
    edited = C.edited_rules(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(1), F.lit(9)), F.array(F.lit(" d "), F.lit("  ")))
    assert one(spark, edited) == ["a", "c", "d"]


@pytest.mark.parametrize(("text", "want"), [("my ssn 123-45-6789", ["pii:SSN"]), ("card 4111 1111 1111 1111 ok", ["pii:credit-card-like"]), ("mail me: é.b@ex.org", ["pii:email"]), ("clean", []), (None, [])])
def test_pii(spark, text, want):
    from rolloom.functions.safety import default_filter

    assert one(spark, C.pii_reasons(F.lit(text).cast("string"))) == want == default_filter(text)[1]


@pytest.mark.parametrize("text", ["0.5", "1/2", "3,000 apples", "-7", "x = .25", "12.", "no", "4/0", "1.50"])
def test_numbers_equal_fractions(spark, text):
    got, want = one(spark, C.number(F.lit(text))), number(text)
    assert (got is None) == (want is None) and (got is None or Fraction(int(got.num), int(got.den)) == want)


def test_equal_numbers(spark):
    assert one(spark, C.equal_numbers(C.number(F.lit("0.5")), C.number(F.lit("1/2")))) is True
    assert one(spark, C.last_answer(F.lit("ANSWER: 3\nno, answer: 1/2 of it\nend"))) == "1/2 of it"
    assert one(spark, C.last_answer(F.lit("none"))) is None
    assert math.isclose(1, 1)
