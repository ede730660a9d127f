"""Typed attribute parsing as built-in Column expressions; what cannot be parsed is null."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_float(value: Column) -> Column:
    """A decimal comma becomes a point, thousands marks and everything but digits go; signs are lost."""
    value = F.regexp_replace(value, r",(?=\d{1,2}\b)", ".")
    value = F.regexp_replace(value, r"[,.](?=\d{3})", "")
    return F.regexp_replace(value, r"[^0-9.]", "").try_cast("double")


def parse_int(value: Column) -> Column:
    """The float, cut toward zero."""
    return parse_float(value).try_cast("bigint")


def parse_float_simple(value: Column) -> Column:
    """The variant for fixed page layouts: only a comma marks thousands, two digits after it are decimals."""
    value = F.regexp_replace(value, r",(?=\d{2}\b)", ".")
    return F.regexp_replace(F.regexp_replace(value, ",", ""), r"[^0-9.]", "").try_cast("double")


def convert_units(value: Column, conversions: Sequence[tuple[str, float]], ignore_case: bool = False) -> Column:
    """The float times the multiplier of the first pattern that is found in the value."""
    factor = F.lit(1.0)
    for pattern, multiplier in reversed(conversions):
        factor = F.when(value.rlike(("(?iu)" if ignore_case else "") + pattern), F.lit(float(multiplier))).otherwise(factor)
    return parse_float(value) * factor


def constrained(values: Column, discard_smaller_than: str | None = None, prioritize_nth_biggest: int | None = None) -> Column:
    """One of an array of numbers: the n-th largest of those not discarded, else the largest if some may be
    discarded, else the first.  ``discard_smaller_than`` is a number or a percentage of the largest."""
    ordered = F.sort_array(values, asc=False)
    first = F.try_element_at(values, F.lit(1))
    if discard_smaller_than is not None:
        least = F.lit(float(discard_smaller_than.rstrip("%")))
        if discard_smaller_than.endswith("%"):
            least = F.array_max(values) * (least / 100)
        ordered = F.filter(ordered, lambda x: x >= least)
        first = F.try_element_at(ordered, F.lit(1))
    if prioritize_nth_biggest is None:
        return first
    return F.coalesce(F.try_element_at(ordered, F.lit(prioritize_nth_biggest)), first)


def parse_date(value: Column) -> Column:
    """A date as text, not padded: year at either end, month beside it, day only where it comes first.

    Missing parts are 01, as is the day of dates that begin with the year; dashes do not separate.
    """
    return _once(
        F.regexp_replace(value, r"[\s,/\\]", "."),
        lambda v: _once(F.regexp_extract(v, r"(\d{4}$|^\d{4})", 1), lambda year: F.when(year != "", _once(F.regexp_replace(v, r"\d{4}$|^\d{4}", "y"), lambda rest: _dated(year, rest)))),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _dated(year: Column, rest: Column) -> Column:
    """The date of a year and of the text with y in the year's place."""

    def parts(found: Column) -> Column:
        day = F.regexp_extract(F.replace(rest, found, F.lit("")), r"^(\d{1,2})", 1)
        month = F.regexp_replace(found, r".?y.?", "")
        return F.when(found == "", F.concat(year, F.lit("-01-01"))).otherwise(_once(day, lambda d: F.concat_ws("-", year, month, F.when(d == "", F.lit("01")).otherwise(d))))

    return _once(F.regexp_extract(rest, r"(\d{1,2}\.y$|^y\.\d{1,2})", 1), parts)


def parse_date_iso(value: Column) -> Column:
    """A proper date where one can be made: dashed and year-first dates keep their day."""
    dashed = F.regexp_replace(value, r"[\s,/\\.]", "-")
    return F.coalesce(F.try_to_date(dashed, "y-M-d"), F.try_to_date(dashed, "d-M-y"), F.try_to_date(parse_date(value), "y-M-d"))


def translate(value: Column, translations: Mapping[str, str], ignore_case: bool = False) -> Column:
    """The value's translation, else the value; with ``ignore_case`` both sides are in lower case."""
    if not translations:
        return F.lower(value) if ignore_case else value
    value = F.lower(value) if ignore_case else value
    pairs = {(k.lower() if ignore_case else k): v for k, v in translations.items()}
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)


def typed(kind: str, values: Column, conversions: Sequence[tuple[str, float]] = (), constraints: Mapping[str, object] | None = None, translations: Mapping[str, str] | None = None, ignore_case: bool = False) -> Column:
    """An attribute's value from the texts found for it, by the type of its rule; no texts or an unknown type: null."""
    first = F.try_element_at(values, F.lit(1))
    if kind in ("float", "int"):
        numbers = F.transform(values, lambda x: convert_units(x, conversions, ignore_case))
        out = constrained(numbers, **(constraints or {}))
        return out.try_cast("bigint") if kind == "int" else out
    if kind == "text":
        return translate(first, translations or {}, ignore_case) if translations is not None else first
    if kind == "date":
        return parse_date(first)
    if kind in ("link", "image_link"):
        return first
    return F.lit(None).cast("string")


def typed_static(kind: str, value: Column, default: Column | None = None) -> Column:
    """Attributes of fixed page layouts: text, float, int, href, alias; anything unparsable is the default."""
    parsed = {"text": F.trim(value), "float": parse_float_simple(value), "int": parse_float_simple(value).try_cast("bigint"), "href": value, "alias": value}
    if kind not in parsed:
        raise ValueError(f"unknown attribute type {kind}")
    return F.coalesce(parsed[kind], default) if default is not None else parsed[kind]


def split_title(title: Column, makes: Sequence[str], model_pattern: str) -> Column:
    """struct(make, model): the first make in the title, whatever its case, and the model in what is left."""
    make = F.lit(None).cast("string")
    for m in reversed(makes):
        make = F.when(F.contains(F.lower(title), F.lit(m.lower())), F.lit(m)).otherwise(make)
    rest = F.trim(F.regexp_replace(title, F.concat(F.lit("(?i)\\Q"), F.coalesce(make, F.lit("")), F.lit("\\E")), F.lit("")))
    model = F.nullif(F.regexp_extract(rest, model_pattern, 0), F.lit(""))
    return F.struct(make.alias("make"), model.alias("model"))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex; nothing for null or empty content."""
    content = content.cast("binary")
    return F.when(F.length(content) > 0, F.sha2(content, 256))


def empty_fields(columns: Sequence[str], unavailable: Sequence[str] = ()) -> Column:
    """How many of the columns are null or empty text, leaving out those a page cannot have."""
    out = F.lit(0)
    for c in columns:
        if c not in unavailable:
            out = out + F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 1).otherwise(0)
    return out


def api_date(value: Column, as_of: Column) -> Column:
    """A date parameter: stray characters go, strict year-month-day, no later than the day before ``as_of``."""
    clean = F.regexp_replace(value, "[^0-9-]", "")
    day = F.when(clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(clean, "y-M-d"))
    return F.when(day <= F.date_sub(as_of, 1), day)
