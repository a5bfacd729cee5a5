"""Kinds of passes and shots as charts call them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the event format and those of the charts.
SET_PIECES = {"Corner": "corner", "Free Kick": "free-kick", "Goal Kick": "goal-kick", "Throw-in": "throw-in", "Kick Off": "kick-off"}
HEIGHTS = {"Ground Pass": "ground", "Low Pass": "low", "High Pass": "high"}
BODY_PARTS = {"Left Foot": "left-foot", "Right Foot": "right-foot", "Head": "head"}
PATTERNS = {"From Corner": "from-corner", "From Counter": "fast-break", "Regular Play": "regular-play"}


def _named(c: Column, names: dict[str, str]) -> Column:
    """The chart's name, null for others."""
    found = F.lit(None).cast("string")
    for name, shown in names.items():
        found = F.when(c == name, shown).otherwise(found)
    return found


def pass_kind(pass_type: Column, height: Column) -> Column:
    """The set piece, else the height."""
    return F.coalesce(_named(pass_type, SET_PIECES), _named(height, HEIGHTS), F.lit("other"))


def body_part(c: Column) -> Column:
    return F.coalesce(_named(c, BODY_PARTS), F.lit("other"))


def shot_context(penalty: Column, shot_type: Column, pattern: Column) -> Column:
    """Penalty before direct free kick before the pattern of play; other patterns that begin ``From`` are set pieces."""
    return F.when(penalty, "penalty").when(shot_type == "Free Kick", "direct-free-kick").otherwise(F.coalesce(_named(pattern, PATTERNS), F.when(F.startswith(pattern, F.lit("From ")), "set-piece"), F.lit("other")))


def period(c: Column) -> Column:
    """Periods beyond the known ones count as the first."""
    return F.when(c.isin(2, 3, 4, 5), c).otherwise(1)
