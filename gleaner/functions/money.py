"""Column functions over amounts of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import params as P
from gleaner.functions.text import let, text_of


def parse_number(c: Column) -> Column:
    """'1,200.9' -> 1200, '45k' -> 45000; anything else null. Fractions are cut, not rounded."""
    bare = F.lower(F.trim(F.replace(c, F.lit(","), F.lit(""))))
    digits = F.regexp_replace(bare, "k$", "")
    number = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
    return F.when(bare.endswith("k"), number * 1000).otherwise(number).try_cast("bigint")


def parse_salary(c: Column) -> Column:
    """struct(min, max, currency, hourly) from an amount string: first and last number."""
    text = text_of(c)
    found = F.regexp_extract_all(text, F.lit(P.NUMBER_PATTERN), F.lit(0))
    numbers = F.array_compact(F.transform(found, parse_number))
    symbol = F.regexp_extract(text, f"({P.CURRENCY_PATTERN})", 1)

    def currency(sign: Column) -> Column:
        out = F.lit("USD")
        for known, code in P.CURRENCY.items():
            out = F.when(sign == known, F.lit(code)).otherwise(out)
        return out

    def bounds(n: Column) -> Column:
        first, last = F.get(n, F.lit(0)), F.get(n, F.size(n) - 1)
        return F.struct(
            F.least(first, last).alias("min"),
            F.greatest(first, last).alias("max"),
            let(symbol, currency).alias("currency"),
            text.rlike(P.HOURLY_IN_AMOUNT).alias("hourly"),
        )

    return let(numbers, bounds)


def salary_from_text(text: Column) -> Column:
    """struct(min, max): yearly bounds of the first amount in the text."""
    body = text_of(text)

    def yearly(snippet: Column, info: Column) -> Column:
        # the earliest copy of the snippet is the match itself
        start = F.instr(body, snippet)
        left = F.greatest(start - P.MONEY_CONTEXT, F.lit(1))
        size = start - left + F.length(snippet) + P.MONEY_CONTEXT
        hourly = (
            info["hourly"]
            | (info["min"] < P.HOURLY_BELOW)
            | F.substring(body, left, size).rlike(P.HOURLY_NEARBY)
        )
        factor = F.when(hourly, F.lit(P.HOURS_PER_YEAR)).otherwise(F.lit(1))
        return let(
            factor,
            lambda f: F.struct(
                F.try_multiply(info["min"], f).alias("min"), F.try_multiply(info["max"], f).alias("max")
            ),
        )

    none = F.struct(F.lit(None).cast("bigint").alias("min"), F.lit(None).cast("bigint").alias("max"))
    return let(
        F.regexp_extract(body, f"({P.MONEY_PATTERN})", 1),
        lambda s: F.when(s == "", none).otherwise(let(parse_salary(s), lambda i: yearly(s, i))),
    )


def _dollars(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 0)), F.lit("?"))


def salary_cell(lo: Column, hi: Column, missing: str = "N/A", dash: str = " – ") -> Column:
    return (
        F.when(lo.isNull() & hi.isNull(), F.lit(missing))
        .when(lo == hi, _dollars(lo))
        .otherwise(F.concat(_dollars(lo), F.lit(dash), _dollars(hi)))
    )
