"""Scalar functions of pitch geometry. Coordinates are 120 x 80, attacking towards x = 120."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as K


def distance_to_goal(x: Column, y: Column) -> Column:
    return F.sqrt((F.lit(K.GOAL_X) - x) * (F.lit(K.GOAL_X) - x) + (F.lit(K.GOAL_Y) - y) * (F.lit(K.GOAL_Y) - y))


def angle_to_goal(x: Column, y: Column) -> Column:
    """Angle that the posts subtend, from the cross and dot product of the directions to them."""
    dx, low, high = F.lit(K.GOAL_X) - x, F.lit(K.POST_LOW) - y, F.lit(K.POST_HIGH) - y
    return F.atan2(F.abs(dx * high - dx * low), dx * dx + low * high)


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def is_progressive(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distance to goal falls by a quarter at least; null is false."""
    before, after = distance_to_goal(x1, y1), distance_to_goal(x2, y2)
    return F.coalesce((before > 0) & (F.try_divide(before - after, before) >= K.PROGRESSIVE_SHARE), F.lit(False))


def enters_final_third(x1: Column, x2: Column) -> Column:
    return F.coalesce((x1 < K.FINAL_THIRD) & (x2 >= K.FINAL_THIRD), F.lit(False))


def zone(x: Column, y: Column) -> Column:
    """3 x 3 zone; out of bounds or null is Unknown."""
    along = F.when(x < 40, "defensive").when(x < 80, "middle").otherwise("attacking")
    across = F.when(y < K.PITCH_WIDTH / 3, "left").when(y < 2 * K.PITCH_WIDTH / 3, "centre").otherwise("right")
    inside = (x >= 0) & (x <= K.PITCH_LENGTH) & (y >= 0) & (y <= K.PITCH_WIDTH)
    return F.when(inside, F.concat(along, F.lit("_"), across)).otherwise(F.lit("Unknown"))


def third(x: Column) -> Column:
    return F.when(x < 40, "Defensive").when(x < 80, "Middle").otherwise("Attacking")


def chart_x(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x / K.PITCH_LENGTH * 100))


def chart_y(y: Column) -> Column:
    """Percent of the width, with the y axis turned up."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(K.PITCH_WIDTH) - y) / K.PITCH_WIDTH * 100))


def with_pass_features(passes):
    """Lengths, directions, zones and flags of passes (start_x, start_y, end_x, end_y)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("start_x", "start_y", "end_x", "end_y"))
    return passes.withColumns(
        {
            "pass_length": length(x1, y1, x2, y2),
            "forward_distance": x2 - x1,
            "lateral_distance": F.abs(y2 - y1),
            "start_goal_distance": distance_to_goal(x1, y1),
            "end_goal_distance": distance_to_goal(x2, y2),
            "progressive": is_progressive(x1, y1, x2, y2),
            "final_third_entry": enters_final_third(x1, x2),
            "start_zone": zone(x1, y1),
            "end_zone": zone(x2, y2),
        }
    )


FEATURES_SQL = """select *, sqrt((end_x-start_x)*(end_x-start_x)+(end_y-start_y)*(end_y-start_y)) as pass_length, end_x-start_x as forward_distance, abs(end_y-start_y) as lateral_distance,
 sqrt((120-start_x)*(120-start_x)+(40-start_y)*(40-start_y)) as sgd, sqrt((120-end_x)*(120-end_x)+(40-end_y)*(40-end_y)) as egd,
 coalesce(sgd > 0 and (sgd-egd)/nullif(sgd,0) >= 0.25, false) as progressive, start_x < 80 and end_x >= 80 as final_third_entry from ({source})"""
