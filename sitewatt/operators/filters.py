"""Scope, time-range and flag filters (FLT-1..8).

Filters are ordinary predicates, so Catalyst pushes them into the Parquet scan
(``PushedFilters``) and prunes date partitions when facts are partitioned.
Parameters arrive as Python values and become Column predicates; nothing is
spliced into SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def scope_predicate(room: str = ALL, rack: str = ALL, server: str | None = ALL,
                    room_col: str = "room_name", rack_col: str = "rack_name",
                    server_col: str = "asset_name") -> Column | None:
    """Conjunction of name equalities; ``"All"`` (or ``None``) drops that term."""
    terms = []
    for value, col in ((room, room_col), (rack, rack_col), (server, server_col)):
        if value is not None and value != ALL:
            terms.append(F.col(col) == F.lit(value))
    if not terms:
        return None
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def scope(df: DataFrame, room: str = ALL, rack: str = ALL, server: str | None = ALL, **cols) -> DataFrame:
    """Room/rack/server scope filter. Pass ``server=None`` for the rack-level
    panels that ignore the server selection on purpose."""
    p = scope_predicate(room, rack, server, **cols)
    return df if p is None else df.where(p)


def is_unscoped(room: str = ALL, rack: str = ALL, server: str | None = ALL) -> bool:
    return scope_predicate(room, rack, server) is None


def _ts_lit(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else F.lit(v)


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts",
               partition_col: str | None = None) -> DataFrame:
    """Inclusive ``[start, end]`` time filter; ``None`` leaves that side open.
    With ``partition_col`` (the date of ``ts``) the same bounds prune partitions."""
    c = F.col(ts)
    if start is not None:
        df = df.where(c >= _ts_lit(start))
        if partition_col:
            df = df.where(F.col(partition_col) >= F.to_date(_ts_lit(start)))
    if end is not None:
        df = df.where(c <= _ts_lit(end))
        if partition_col:
            df = df.where(F.col(partition_col) <= F.to_date(_ts_lit(end)))
    return df


def flag(df: DataFrame, column: str, value: bool = True) -> DataFrame:
    """Boolean flag filter (visible sources, user-added sources)."""
    return df.where(F.col(column) == F.lit(value))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Equality lookup by a name argument."""
    return df.where(F.col(column) == F.lit(value))


def one_of(df: DataFrame, column: str, values) -> DataFrame:
    """``IN`` list filter."""
    return df.where(F.col(column).isin(list(values)))


def at_least(df: DataFrame, column: str, threshold) -> DataFrame:
    """Threshold predicate ``column >= threshold``."""
    return df.where(F.col(column) >= F.lit(threshold))
