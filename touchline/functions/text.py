"""Scalar functions on text, names, clocks and formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def category(c: Column, default: str) -> Column:
    """Trimmed; blank or null becomes the default."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def clock_seconds(c: Column) -> Column:
    """``HH:MM:SS.mmm`` as seconds; null unless there are exactly three numeric parts."""
    parts = F.split(c, ":", -1)
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, part(0) * 3600 + part(1) * 60 + part(2))


def season(c: Column) -> Column:
    """``2023-24`` and ``2023/2024`` as ``2023/2024``; others unchanged."""
    first, second = F.regexp_extract(c, r"^(\d{4})[-/](\d{2,4})$", 1), F.regexp_extract(c, r"^(\d{4})[-/](\d{2,4})$", 2)
    return F.when(first == "", c).otherwise(F.concat(first, F.lit("/"), F.when(F.length(second) == 2, F.concat(F.substring(first, 1, 2), second)).otherwise(second)))


_APOSTROPHES = "'’ʼ＇"


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    """Unicode's normal form KC and full case folding, which Spark doesn't have."""
    return names.map(lambda name: unicodedata.normalize("NFKC", name).casefold(), na_action="ignore")


def name_key(c: Column) -> Column:
    """A name for comparing: folded, without apostrophes, everything but letters, marks and numbers as single spaces. Only names beyond ASCII meet a Python worker."""
    folded = F.when(F.rlike(c, F.lit(r"^[\x00-\x7F]*$")), F.lower(c)).otherwise(_composed(c))
    return F.trim(F.regexp_replace(F.translate(folded, _APOSTROPHES, ""), r"[^\p{L}\p{M}\p{N}]+", " "))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def citation_ids(c: Column) -> Column:
    """Ids inside ``[a; b]`` groups, repeats included; a group counts only if each of its members is an id, which holds ``evidence`` and no white space."""
    groups = F.regexp_extract_all(c, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    members = F.transform(groups, lambda g: F.transform(F.split(g, ";", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.flatten(F.filter(members, lambda m: F.forall(m, lambda x: F.rlike(x, F.lit(r"^(?i)(?=\S*evidence)\S+$")))))


# Domains of the two better classes of sources.
OFFICIAL_DOMAINS = ("bundesliga.com", "uefa.com", "fifa.com", "dfb.de", "premierleague.com", "laliga.com")
REPUTABLE_DOMAINS = ("reuters.com", "bbc.com", "espn.com", "goal.com", "kicker.de", "liverpoolecho.co.uk", "skysports.com", "theathletic.com")


def source_quality(host: Column, official=OFFICIAL_DOMAINS, reputable=REPUTABLE_DOMAINS) -> Column:
    """``official``, ``reputable_media`` or ``other``, by the host or a domain above it."""
    name = F.regexp_replace(F.lower(host), r"^www\.", "")

    def of(domains) -> Column:
        parts = F.split(name, r"\.")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        return F.arrays_overlap(above, F.array(*[F.lit(d) for d in domains]))

    return F.when(of(official), "official").when(of(reputable), "reputable_media").otherwise("other")


def action_number_band(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")


def difficulty_band(p: Column) -> Column:
    return F.when(p < 0.6, "difficult").when(p <= 0.85, "moderate").when(p.isNotNull(), "easy")


def cost(units: Column, cached: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost of units of which some were cached, at prices of a million; null where the model has no price."""
    found = F.lit(None).cast("double")
    for name, (full, low) in prices.items():
        found = F.when(model == name, ((units - cached) * full + cached * low) / 1e6).otherwise(found)
    return found


def logistic(margin: Column, temperature: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), margin / temperature))))


def similarity_index(distance: Column, d50: Column) -> Column:
    """100 at distance 0 and 50 at ``d50``."""
    return F.lit(100.0) * F.exp(-F.log(F.lit(2.0)) * F.try_divide(distance, d50))


def percent_label(c: Column) -> Column:
    """One decimal, half to even; null is a dash."""
    return F.coalesce(F.concat(F.format_string("%.1f", F.bround(c * 100, 1)), F.lit("%")), F.lit("-"))


def ordinal(c: Column) -> Column:
    n = c.cast("int")
    end = F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)
