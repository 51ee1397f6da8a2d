"""Period keys, lenient dates and epoch times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewmill.fixed_values import DAY_SPAN_DAYS, WEEK_SPAN_DAYS

DAY, WEEK, MONTH = "day", "week", "month"
GRANULARITIES = (DAY, WEEK, MONTH)

# English names in dates, by their first letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NAME = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
)
DAY_NAME = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])"
NUMBER = r"\d{1,2}(?:st|nd|rd|th)(?![a-z])|\d+"
SEPARATOR = r"[\s,./'\u2019-]|(?:of|the)(?![a-z])"
DATE_TEXT = rf"^(?:{MONTH_NAME}|{DAY_NAME}|{NUMBER}|{SEPARATOR})+$"
LAST_TWO_DIGIT_YEAR = 68  # 68 is 2068, 69 is 1969
# A time of day behind a date, with or without seconds, fractions and zone; it is left out.
TIME_OF_DAY = r"(?i)[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[AP]M)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?$"


def granularity_of(first: Column, last: Column) -> Column:
    """"day", "week" or "month" by the exact span between two timestamps."""
    span = last - first
    return (
        F.when(span < F.make_dt_interval(F.lit(DAY_SPAN_DAYS)), F.lit(DAY))
        .when(span < F.make_dt_interval(F.lit(WEEK_SPAN_DAYS)), F.lit(WEEK))
        .otherwise(F.lit(MONTH))
    )


def _by_granularity(granularity: Column, day: Column, week: Column, month: Column) -> Column:
    return F.when(granularity == DAY, day).when(granularity == WEEK, week).otherwise(month)


def period_start(ts: Column, granularity: Column) -> Column:
    """First day of the period ``ts`` lies in (weeks start on Monday)."""
    return _by_granularity(
        granularity,
        day=F.to_date(ts),
        week=F.trunc(ts, "week"),
        month=F.trunc(ts, "month"),
    )


def period_label(start: Column, granularity: Column) -> Column:
    """Date a period is shown under: the day, the closing Sunday, the last day of the month."""
    return _by_granularity(
        granularity, day=start, week=F.date_add(start, 6), month=F.last_day(start)
    )


def period_starts(first: Column, last: Column, granularity: Column) -> Column:
    """Array of all period starts from ``first`` up to ``last``."""
    return _by_granularity(
        granularity,
        day=F.sequence(first, last, F.expr("INTERVAL 1 DAY")),
        week=F.sequence(first, last, F.expr("INTERVAL 7 DAY")),
        month=F.sequence(first, last, F.expr("INTERVAL 1 MONTH")),
    )


def parse_date(text: Column) -> Column:
    """Date of a lenient text; empty or unreadable text, or one without a year, gives NULL.

    A text is read as tokens: a month name, numbers, and what does not count (day names, ordinal endings, separators,
    a time of day behind). A number of four digits, or above 31, is the year, else the last one. Of two other numbers
    the first is the month, unless it is above 12 and the second is not. Without a day the period begins.
    """
    text = F.lower(F.regexp_replace(F.trim(text), TIME_OF_DAY, ""))
    name = F.substring(F.regexp_extract(text, rf"(?<![a-z])({MONTH_NAME})", 1), 1, 3)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))

    def read(parts: Column) -> Column:
        digits, n = parts["numbers"], F.size(parts["numbers"])
        values = F.transform(digits, lambda d: F.when(F.length(d) <= 4, d.cast("int")))
        long = F.transform(digits, lambda d: (F.length(d) == 4) | ((F.length(d) == 2) & (d.cast("int") > 31)))
        whole = F.regexp_extract_all(F.get(digits, F.lit(0)), F.lit(r"^(\d{4})(\d{2})(\d{2})$"), F.lit(0))
        at = F.when(F.array_position(long, True) > 0, F.array_position(long, True).cast("int") - 1).when(
            ((parts["month"] > 0) & (n == 2)) | (n == 3), n - 1
        )
        rest = F.filter(F.transform(values, lambda v, i: F.when(i != at, v)), lambda v: v.isNotNull())
        first, second = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
        swapped = (first > 12) & (second <= 12)
        month = F.when(parts["month"] > 0, parts["month"]).when(swapped, second).otherwise(F.coalesce(first, F.lit(1)))
        day = F.when(parts["month"] > 0, F.coalesce(first, F.lit(1))).when(swapped, first).otherwise(F.coalesce(second, F.lit(1)))
        year, short = F.get(values, at), F.length(F.get(digits, at)) <= 2
        year = F.when(short, year + F.when(year <= LAST_TWO_DIGIT_YEAR, 2000).otherwise(1900)).otherwise(year)
        most = F.when(parts["month"] > 0, 2).otherwise(3)
        middle = (n == 3) & (at == 1) & (parts["month"] == 0)  # a year between two numbers
        known = F.forall(values, lambda v: v.isNotNull()) & (n <= most) & ~middle & ~((n == 1) & (F.length(digits[0]) < 4) & (parts["month"] == 0))
        spelled = F.format_string("%04d-%02d-%02d", year, month, day)
        compact = F.when((n == 1) & (F.size(whole) == 1) & (parts["month"] == 0), F.try_to_date(digits[0], "yyyyMMdd"))
        return F.coalesce(compact, F.when(known & year.isNotNull(), F.try_to_date(spelled, "yyyy-MM-dd")))

    parts = F.struct(numbers.alias("numbers"), F.coalesce(named, F.lit(0)).alias("month"))
    found = F.get(F.transform(F.array(parts), read), F.lit(0))
    return F.when(F.rlike(text, F.lit(DATE_TEXT)) & (F.size(numbers) > 0), found)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 UTC, rounded half-even."""
    return F.bround(F.unix_micros(ts) / 1000).cast("bigint")
