"""Conforming views over the given tables, as Spark DataFrames and as SQL text for the oracle.

Every operator is parametrised by column names and runs on any table of this shape; these adapters only supply data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.session import table

_LINE = {
    "match_id": "l_orderkey % 34",
    "order_key": "l_orderkey",
    "player_id": "l_suppkey",
    "player_name": "s_name",
    "team_id": "cast(s_nationkey as bigint)",
    "team_name": "n_name",
    "position": "p_type",
    "position_group": "case l_suppkey % 7 when 0 then 'GK' when 1 then 'FWD' when 2 then 'FWD' when 3 then 'MID' when 4 then 'MID' else 'DEF' end",
    "completed": "case when l_returnflag <> 'R' then 1 else 0 end",
    "expected_completion": "0.5 + 4 * l_discount",
    "under_pressure": "l_linenumber % 4 = 0",
    "start_x": "cast((l_partkey * 37 + l_linenumber * 11) % 121 as double)",
    "start_y": "cast((l_partkey * 17 + l_suppkey * 5) % 81 as double)",
    "end_x": "cast((l_orderkey * 13 + l_linenumber * 29) % 121 as double)",
    "end_y": "cast((l_orderkey * 7 + l_partkey * 3) % 81 as double)",
    "action_type": "case when l_linenumber % 3 = 0 then 'Carry' else 'Pass' end",
    "attacking_value": "l_tax - l_discount",
    "quantity": "l_quantity",
    "expected_goal": "l_discount * 5",
    "goal": "l_linestatus = 'F'",
    "match_number": "l_linenumber",
}
_TABLES = "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey"
PASSES_SQL = f"select {', '.join(f'{e} as {k}' for k, e in _LINE.items())} from {_TABLES}"
SHOTS_SQL = f"select * from ({PASSES_SQL}) where quantity >= 45"

_EVENT = {
    "event_id": "event_id",
    "match_id": "user_id",
    "ts": "ts",
    "event_type": "case event_type when 'view' then 'Pass' when 'click' then 'Carry' when 'purchase' then 'Shot' when 'signup' then 'Own Goal For' else 'Dispossessed' end",
    "team_id": "event_id % 2",
    "xg": "case when event_type = 'purchase' then value / 500 else 0.0 end",
    "is_goal": "case when event_type = 'signup' or (event_type = 'purchase' and value > 100) then 1 else 0 end",
    "value": "value",
    "props": "props",
}
EVENTS_SQL = f"select {', '.join(f'{e} as {k}' for k, e in _EVENT.items())} from events"


_OF_DIMENSIONS = ("player_name", "team_id", "team_name", "position")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the facts' own columns only: no name, team or position, and so no join."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {k}" for k, e in _LINE.items() if k not in _OF_DIMENSIONS])


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and carries with player, team, coordinates and values; the dimension tables are left to the optimizer."""
    line = table(spark, sf_dir, "lineitem")
    supplier, nation, part = (table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey).join(part, line.l_partkey == part.p_partkey)
    return joined.selectExpr(*[f"{e} as {k}" for k, e in _LINE.items()])


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes(spark, sf_dir).where("quantity >= 45")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered events of a match (here: a user)."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {k}" for k, e in _EVENT.items()])
