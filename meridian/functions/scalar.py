"""Scalar functions on values, dates and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column, least: float = 1e-6) -> Column:
    """Quotient; null where a side is null or NaN, or the denominator is smaller than ``least``."""
    a, b = F.nanvl(numerator.cast("double"), F.lit(None)), F.nanvl(denominator.cast("double"), F.lit(None))
    return F.when(F.abs(b) >= least, a / b)


def signed_growth(now: Column, before: Column, least: float = 1e-6) -> Column:
    """Change against the size of ``before``, so that a smaller loss is growth."""
    return F.when(F.abs(before) >= least, (now - before) / F.abs(before))


def log_level(value: Column) -> Column:
    return F.when(value > 0, F.log(value))


def same_unit_ratio(numerator: Column, denominator: Column, unit_a: Column, unit_b: Column) -> Column:
    """Quotient; null if both units are known and differ."""
    differ = F.coalesce((unit_a != "") & (unit_b != "") & (unit_a != unit_b), F.lit(False))
    return F.when(~differ, safe_ratio(numerator, denominator))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarters_before(day: Column, n: int) -> Column:
    """Indices of the n quarters before the day's own, oldest first."""
    q = F.year(day) * 4 + F.quarter(day) - 1
    return F.when(day.isNotNull(), F.transform(F.sequence(F.lit(-n), F.lit(-1)), lambda i: q + i))


def unit_currency(unit: Column) -> Column:
    """The currency code that a unit starts with, alone or before ``/``; empty without one."""
    return F.regexp_extract(unit, "^([A-Z]{3})(/|$)", 1)


def base_form(form: Column) -> Column:
    """A form without the mark of an amendment."""
    return F.regexp_replace(F.upper(F.btrim(form)), "/A$", "")


def padded_id(number: Column, width: int = 10) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def archive_path(cik: Column, accession: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("archive"), cik.cast("string"), F.regexp_replace(accession, "-", ""), name)


def exhibit_type(kind: Column) -> Column:
    """``EX-99.01`` and ``ex-99.1`` are one type."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.btrim(kind)), r"\s+", ""), r"^(EX-\d+)\.0*(\d+)$", "$1.$2")


def split_ratio(text: Column) -> Column:
    """``2:1`` as 2.0; null unless both sides are positive."""
    parts = F.split(text, ":")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when((F.size(parts) == 2) & (a > 0) & (b > 0), a / b)


def period_label(bucket: Column, end: Column, fiscal_year: Column) -> Column:
    year = F.coalesce(fiscal_year.cast("string"), F.year(end).cast("string"))
    return F.when(bucket == "instant", F.date_format(end, "yyyy-MM-dd")).when(bucket == "FY", F.concat(F.lit("FY"), year)).otherwise(F.concat_ws(" ", bucket, F.date_format(end, "yyyy-MM")))


def has_item(items: Column, item: str) -> Column:
    """Whether a comma-parted list has exactly this element."""
    return F.coalesce(F.array_contains(F.transform(F.split(items, ","), lambda x: F.btrim(x)), item), F.lit(False))


def masked(value: Column, *unless: Column) -> Column:
    """The value, or null where one of the conditions holds; a null condition doesn't."""
    hide = F.lit(False)
    for c in unless:
        hide = hide | F.coalesce(c, F.lit(False))
    return F.when(~hide, value)


def in_ranges(number: Column, exact: dict[int, str], ranges: list[tuple[int, int, str]], otherwise: str) -> Column:
    """The label of an exact code, else of the first range (both bounds count) that holds it, else ``otherwise``; null and non-positive codes too."""
    hits = [F.when(number == k, v) for k, v in exact.items()] + [F.when(number.between(a, b), v) for a, b, v in ranges]
    return F.when(number > 0, F.coalesce(*hits, F.lit(otherwise))).otherwise(otherwise)


def unwrapped_document(raw: Column) -> Column:
    """The content of the first ``<TEXT>`` of a document wrapper, or the whole text without one."""
    inner = F.regexp_extract(raw, r"(?is)<TEXT>\s*(.*?)\s*</TEXT>", 1)
    return F.when(inner != "", inner).otherwise(raw)


def quarter_ends(first: Column, last: Column) -> Column:
    """Last days of the quarters that end from ``first`` to ``last``, both included: those that can have been reported."""
    months = F.sequence(F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("interval 3 months"))
    return F.filter(F.transform(months, lambda m: F.last_day(F.add_months(m, 2))), lambda e: (e >= first) & (e <= last))


def yearly_dates(first_year: int, last_year: int, month: int, day: int) -> Column:
    """The same day of every year."""
    return F.transform(F.sequence(F.lit(first_year), F.lit(last_year)), lambda y: F.make_date(y, F.lit(month), F.lit(day)))


def amount_text(value: Column, unit: Column) -> Column:
    """An amount for readers: in billions, millions or thousands with one digit, per-share amounts with two; null stays null."""
    size = F.abs(value)
    scaled = (
        F.when(F.contains(unit, F.lit("/")), F.format_number(value, 2))
        .when(size >= 1e9, F.concat(F.format_number(value / 1e9, 1), F.lit("bn")))
        .when(size >= 1e6, F.concat(F.format_number(value / 1e6, 1), F.lit("m")))
        .when(size >= 1e3, F.concat(F.format_number(value / 1e3, 1), F.lit("k")))
        .otherwise(F.format_number(value, 0))
    )
    return F.when(value.isNotNull(), F.concat_ws(" ", scaled, unit))


def common_ticker(tickers: Column, vetoed: Column) -> Column:
    """The first ticker, in the order given, that is no unit, warrant, right or preferred share; null if the veto list has it."""
    plain = F.filter(tickers, lambda t: t.isNotNull() & ~F.rlike(t, F.lit(r"[-.](W|WS|WT|U|UN|R|RT|P[A-Z]?)$")))
    first = F.try_element_at(plain, F.lit(1))
    return F.when(~F.coalesce(F.array_contains(vetoed, first), F.lit(False)), first)


def event_kind(form: Column, items: Column, by_form: dict[str, str], by_item: dict[str, str]) -> Column:
    """Kind of event of a filing: that of its form first, else that of the first listed item that it has; null for none."""
    kinds = [F.when(base_form(form) == f, k) for f, k in by_form.items()] + [F.when(has_item(items, i), k) for i, k in by_item.items()]
    return F.coalesce(*kinds)


def imputed(value: Column, applicable: Column, default: str) -> Column:
    """Struct of ``value``, with the default where it is missing though it applies, and ``is_imputed``; where it does not apply it is null."""
    missing = value.isNull() & F.coalesce(applicable, F.lit(False))
    return F.struct(F.when(F.coalesce(applicable, F.lit(False)), F.coalesce(value, F.lit(default))).alias("value"), missing.alias("is_imputed"))
