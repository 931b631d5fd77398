"""Column functions over dates found in text or held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions.text import text_of

_TRIGGER = "(?i)" + P.DEADLINE_TRIGGER
_ISO = _TRIGGER + r"(\d{4})-(\d{1,2})-(\d{1,2})"
_MONTH_FIRST = _TRIGGER + rf"({P.MONTH_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
_DAY_FIRST = _TRIGGER + rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({P.MONTH_NAMES})\.?,?\s+(\d{{4}})"
_SLASH = _TRIGGER + r"(\d{1,2})/(\d{1,2})/(\d{4})"


def _make_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _month_number(name: Column) -> Column:
    key = F.lower(F.substring(name, 1, 3))
    out = F.lit(None).cast("string")
    for short, number in P.MONTH_NUMBER.items():
        out = F.when(key == short, F.lit(str(number))).otherwise(out)
    return out


def extract_deadline(text: Column) -> Column:
    """Date behind a deadline phrase. Forms are tried in a fixed order, and the first form that
    occurs decides: an impossible date there gives null."""
    body = text_of(text)

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(body, pattern, n)

    dated = (
        F.when(body.rlike(_ISO), _make_date(group(_ISO, 1), group(_ISO, 2), group(_ISO, 3)))
        .when(
            body.rlike(_MONTH_FIRST),
            _make_date(
                group(_MONTH_FIRST, 3), _month_number(group(_MONTH_FIRST, 1)), group(_MONTH_FIRST, 2)
            ),
        )
        .when(
            body.rlike(_DAY_FIRST),
            _make_date(
                group(_DAY_FIRST, 3), _month_number(group(_DAY_FIRST, 2)), group(_DAY_FIRST, 1)
            ),
        )
        .when(body.rlike(_SLASH), _make_date(group(_SLASH, 3), group(_SLASH, 2), group(_SLASH, 1)))
    )
    return F.when(body.rlike(_TRIGGER), dated)


def date_cell(c: Column) -> Column:
    """ISO timestamp text to its date; other text to its first ten characters; null to ''."""
    day = F.substring(c, 1, 10)
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])")
    parsed = F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.coalesce(F.when(iso, F.coalesce(parsed, day)).otherwise(day), F.lit(""))


def days_until(day: Column, today: Column) -> Column:
    return F.datediff(day, today).cast("bigint")


def whole_days_since(moment: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(moment)) / 86_400_000_000).cast("bigint")
