"""Scalar functions as Columns: ids, exact numbers, text, rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are summed as integers of this unit, so that means are correctly rounded whatever the order of rows.
UNIT = 10_000_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_id(*parts: Column | str | int, length: int = 12) -> Column:
    """Content id: a prefix of the SHA-256 of the parts, parted by bars; a null part is written None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, length)


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; NaN is high, null stays null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def exact_sum(x: Column | str, when: Column | None = None) -> Column:
    """Aggregate: the sum as an integer of UNITs; 0 of no rows."""
    scaled = F.round(_col(x) * UNIT).cast("long")
    return F.coalesce(F.sum(scaled if when is None else F.when(when, scaled)), F.lit(0))


def exact_mean(x: Column | str, when: Column | None = None) -> Column:
    """Aggregate: the mean with one rounding; 0.0 of no rows."""
    n = F.count(_col(x)) if when is None else F.count(F.when(when, _col(x)))
    return F.when(n > 0, exact_sum(x, when).cast("double") / (n.cast("double") * float(UNIT))).otherwise(0.0)


def fixed(x: Column | str, digits: int = 3) -> Column:
    """Text with so many decimals, from the exact binary value, halves to even."""
    return F.call_function("format_number", _col(x), F.lit("0." + "0" * digits))


def rounded(x: Column | str, digits: int = 3) -> Column:
    return fixed(x, digits).cast("double")


def weight(x: Column | str, most: int) -> Column:
    """A rubric weight from text or number: truncated, 1 if it isn't a number, within 1 and most."""
    as_int = _col(x).try_cast("double").try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(as_int, F.lit(1))))


def reasons(*cases: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for c, t in cases)))


def reason_key(reason: Column | str, mark: str = " ") -> Column:
    return F.split_part(_col(reason), F.lit(mark), F.lit(1))


def bullets(items: Column | str, limit: int | None = None, empty: str = "(none)") -> Column:
    """One '- item' line each; `empty` for null or no items."""
    line = lambda x: F.concat(F.lit("- "), x if limit is None else F.substring(x, 1, limit))
    return F.when(F.coalesce(F.size(_col(items)), F.lit(0)) > 0, F.array_join(F.transform(_col(items), line), "\n")).otherwise(F.lit(empty))


def joined_messages(messages: Column | str) -> Column:
    return F.array_join(F.transform(_col(messages), lambda m: m.content), " ")


RULE_HEAD = "Further rules:\n"


def with_rules(messages: Column | str, rules: Column | str) -> Column:
    """Appends the rules to the first message if that is a system message, else puts one before; no rules: unchanged."""
    messages, rules = _col(messages), _col(rules)
    block = F.concat(F.lit(RULE_HEAD), bullets(rules))
    first_is_system = F.coalesce(F.try_element_at(messages, F.lit(1)).role == "system", F.lit(False))
    extended = F.transform(messages, lambda m, i: F.when(i == 0, F.struct(m.role.alias("role"), F.concat(F.coalesce(m.content, F.lit("")), F.lit("\n\n"), block).alias("content"))).otherwise(F.struct(m.role.alias("role"), m.content.alias("content"))))
    inserted = F.concat(F.array(F.struct(F.lit("system").alias("role"), block.alias("content"))), F.transform(messages, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))))
    return F.when(F.coalesce(F.size(rules), F.lit(0)) == 0, F.transform(messages, lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))).when(first_is_system, extended).otherwise(inserted)


def edited_rules(rules: Column | str, remove: Column, add: Column) -> Column:
    """Without the elements at the given places (0-based, others are ignored), then with the non-blank additions, trimmed."""
    kept = F.filter(_col(rules), lambda r, i: ~F.coalesce(F.array_contains(remove, i), F.lit(False)))
    return F.concat(kept, F.filter(F.transform(add, lambda a: F.trim(a)), lambda a: a != ""))


def provider(model: Column | str) -> Column:
    """Before the first slash; the whole name without one."""
    return F.split_part(_col(model), F.lit("/"), F.lit(1))


def model_name(model: Column | str) -> Column:
    """After the first slash; the whole name without one."""
    m = _col(model)
    return F.when(F.contains(m, F.lit("/")), F.substr(m, F.instr(m, "/") + 1)).otherwise(m)


def peek_round(text: Column | str) -> Column:
    got = F.regexp_extract(_col(text), r"ROUND[=:\s]+([0-9]+)", 1)
    return F.when(got == "", 1).otherwise(got.cast("int"))


def unfenced(text: Column | str) -> Column:
    """Without the fence around a fenced reply."""
    return F.trim(F.regexp_replace(_col(text), r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", "$1"))


#: The patterns of the default safety filter; digits and word characters beyond ASCII count, as does a final line end.
PII = (
    ("SSN", r"(?dU)\b\d\d\d-\d\d-\d\d\d\d\b"),
    ("credit-card-like", r"(?dU)\b(?:\d[-\x20]*?){13,19}\b"),
    ("email", r"(?dU)\b[-+.\w]+@[-\w]+\.[-.\w]+\b"),
)


def pii_reasons(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return reasons(*((F.rlike(t, F.lit(p)), F.lit(f"pii:{name}")) for name, p in PII))


ANSWER = r"(?id)ANSWER:\s*(.+)"
NUMBER = r"-?[0-9]+/[0-9]+|-?[0-9]*\.[0-9]+|-?[0-9]+\.?[0-9]*"


def last_answer(text: Column | str) -> Column:
    """What follows the last ANSWER: on its line; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(_col(text), F.lit(ANSWER), F.lit(1)), F.lit(-1))


def number(text: Column | str) -> Column:
    """The first number as struct(num, den) of DECIMAL(38,0); null without one, beyond 18 digits or over zero."""
    got = F.regexp_extract(F.replace(_col(text), F.lit(","), F.lit("")), NUMBER, 0)
    got = F.rtrim(got, F.lit("."))
    whole, part = F.split_part(got, F.lit("."), F.lit(1)), F.split_part(got, F.lit("."), F.lit(2))
    digits = F.length(part)
    dec = lambda c: c.try_cast("decimal(38,0)")
    over = F.contains(got, F.lit("/"))
    num = F.when(over, dec(F.split_part(got, F.lit("/"), F.lit(1)))).otherwise(dec(F.concat(whole, part)))
    den = F.when(over, dec(F.split_part(got, F.lit("/"), F.lit(2)))).otherwise(dec(F.rpad(F.lit("1"), 1 + digits, "0")))
    short = (got != "") & (F.length(got) <= 18)
    return F.when(short & (den != 0) & num.isNotNull(), F.struct(num.alias("num"), den.alias("den")))


def equal_numbers(a: Column, b: Column) -> Column:
    """Exactly, by cross multiplication; null if either is no number."""
    return a.num * b.den == b.num * a.den
