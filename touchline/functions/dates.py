"""Windows of time that a question asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MOST_DAYS = 3650


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return text.try_cast("date")


def published_since(question: Column, today: Column) -> Column:
    """The first day of the news that a question wants, null if it names none.

    In this order: the last n days (1 to 3650), the last month (30 days), since an ISO date, since a day of a month (of the last twelve months
    if no year is given), news of a year. A date that doesn't exist gives null.
    """
    part = lambda pattern, i: F.nullif(F.regexp_extract(question, pattern, i), F.lit(""))
    days = part(r"(?i)\b(?:in\s+)?(?:the\s+)?(?:last|past)\s+([0-9]{1,4})\s+days?\b", 1).try_cast("int")
    month_ago = F.rlike(question, F.lit(r"(?i)\b(?:in\s+)?(?:the\s+)?(?:last|past)\s+month\b"))
    iso = r"\bsince\s+(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})\b"
    named = rf"(?i)\bsince\s+({'|'.join(MONTHS)})\s+([0-9]{{1,2}})(?:,?\s+(20[0-9]{{2}}))?\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(named, 1))).cast("string")
    year = part(named, 3)
    this_year = _date(F.year(today).cast("string"), month, part(named, 2))
    last_year = _date((F.year(today) - 1).cast("string"), month, part(named, 2))
    in_named = F.when(year.isNotNull(), _date(year, month, part(named, 2))).when(this_year > today, last_year).otherwise(this_year)
    of_year = part(r"(?i)\bnews(?:\s+(?:on|about)\s+.+?)?\s+(?:from|in)\s+(20[0-9]{2})\b", 1)
    return (
        F.when(days.between(1, MOST_DAYS), F.date_sub(today, days))
        .when(month_ago, F.date_sub(today, 30))
        .when(part(iso, 1).isNotNull(), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(part(named, 1).isNotNull(), in_named)
        .when(of_year.isNotNull(), _date(of_year, F.lit("1"), F.lit("1")))
    )
