"""Column functions: lenient parsing, names, ratios, buckets and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def parse_number(c: Column, kind: str = MONEY) -> Column:
    """Blanks and thousands commas go; what is no number becomes null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast(kind)


def parse_number_or_zero(c: Column, kind: str = MONEY) -> Column:
    """As parse_number, but a trailing minus negates and what is no number becomes 0."""
    t = F.regexp_replace(F.trim(c), ",", "")
    value = F.when(t.endswith("-"), -F.regexp_replace(t, "-$", "").try_cast(kind)).otherwise(t.try_cast(kind))
    return F.coalesce(value, F.lit(0)).cast(kind)


def to_numbers(columns: Sequence[str], kind: str = "double") -> dict[str, Column]:
    """For withColumns: each column cast leniently, nulls as 0."""
    return {c: F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind)) for c in columns}


def parse_date(c: Column, formats: Sequence[str] = ("yyyy/M/d", "yyyy-M-d", "d/M/yyyy")) -> Column:
    """The first of formats that fits; else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_of_text(c: Column) -> Column:
    """YYYY-MM of a text that starts with a year and a month, with or without a leading zero, parted by a dash, a
    slash, a dot or nothing but two digits; what is no month gives null."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(c), r"^(\d{4})(?:[-/.](\d{1,2})|(\d{2}))(?!\d)", k), F.lit(""))
    year, number = part(1), F.coalesce(part(2), part(3)).try_cast("int")
    return F.when(number.between(1, 12), F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0")))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def invoice_status(total: Column, remaining: Column) -> Column:
    return F.when(total.isNull() | (total == 0), "zero").when(F.coalesce(remaining, F.lit(0)) <= 0, "paid").otherwise("unpaid")


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b as double; null (or default) where b is null or 0."""
    found = F.try_divide(a.cast("double"), b.cast("double"))
    return found if default is None else F.coalesce(found, F.lit(default))


#: Letter variants and the letters that stand for them.
VARIANTS, LETTERS = "أإآىة", "ااايه"


def match_key(c: Column) -> Column:
    """For matching names: Arabic letter variants made one, all but letters and digits dropped."""
    return F.lower(F.regexp_replace(F.translate(c, VARIANTS, LETTERS), r"[^\p{L}\p{N}_]", ""))


def name_key(c: Column) -> Column:
    """For attributing names: also without tatweel and vowel marks, blanks made single."""
    plain = F.translate(F.regexp_replace(c, "[\\u064B-\\u0652\\u0640]", ""), VARIANTS, LETTERS)
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def display_name(c: Column) -> Column:
    """Tatweel dropped, a final dotless ya dotted, blanks made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\u0640", ""), "\\u0649(?=\\s|$)", "\u064A"), r"\s+", " "))


def usable_name(c: Column) -> Column:
    return F.coalesce((F.trim(c) != "") & ~c.rlike(r"^[\d\s]*$"), F.lit(False))


def canonical_code(c: Column) -> Column:
    """A code without commas and blanks, to be joined with an alias table."""
    return F.trim(F.regexp_replace(c, ",", ""))


def pack_size(c: Column) -> Column:
    """The leading whole number of a text."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("double")


def boxes(qty: Column, pack: Column) -> Column:
    return F.when(pack > 0, qty.cast("double") / pack)


def net_value(qty: Column, price: Column, discount: Column, tax: Column) -> Column:
    """The expected line total; both rates reduce it."""
    return qty * price * (1 - discount) * (1 - tax)


def month_label(c: Column, names: Sequence[str]) -> Column:
    """A YYYY-MM key with the month's name out of twelve."""
    return F.concat(F.element_at(F.array(*map(F.lit, names)), F.substring(c, 6, 2).try_cast("int")), F.lit(" "), F.substring(c, 1, 4))


#: Ageing buckets by days, half-open at the right.
AGING = (("d1_30", 0, 31), ("d31_60", 31, 61), ("d61_90", 61, 91), ("d91_120", 91, 121), ("d120p", 121, None))
#: Incentive by collection rate, half-open at the right; the last tier has no end.
TIERS = ((0.70, 0.01), (0.80, 0.02), (0.90, 0.03), (0.95, 0.05))


def aging_bucket(days: Column, buckets: Sequence[tuple] = AGING) -> Column:
    """The bucket of a number of days; fewer than the first bound count as the first bucket."""
    out = None
    for name, _, end in buckets:
        out = (F.when if out is None else out.when)(days < end, name) if end is not None else out.otherwise(name)
    return out


def incentive(rate: Column, tiers: Sequence[tuple] = TIERS) -> Column:
    out = F.lit(0.0)
    for bound, share in tiers:
        out = F.when(rate >= bound, share).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def rate_class(rate: Column) -> Column:
    """Classes of a collection rate."""
    return F.when(rate >= 0.9, "good").when(rate >= 0.7, "fair").otherwise("poor")


def first_rule(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first (pattern, label) that matches."""
    out = None
    for pattern, label in rules:
        out = (F.when if out is None else out.when)(c.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
