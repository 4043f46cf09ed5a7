"""Running aggregates per key that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here the rows of a hot
key are cut into segments of bounded size along the running order. Each segment is reduced to one
partial row, the partials are accumulated per key (a few rows), and the accumulated carry is joined
back, so that segments run in parallel and still give the running value over the whole key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

SEGMENT = "_segment"


@dataclass(frozen=True)
class Running:
    """One running value. ``fn`` is sum, max, first, last (latest non-null), prev (value of the row
    before) or max_before (maximum over the rows strictly before)."""

    name: str
    fn: str
    column: Column

    def over_rows(self, window) -> Column:
        inclusive = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.fn == "prev":
            return F.lag(self.column).over(window)
        if self.fn == "max_before":
            return F.max(self.column).over(window.rowsBetween(Window.unboundedPreceding, -1))
        if self.fn == "last":
            return F.last(self.column, ignorenulls=True).over(inclusive)
        return {"sum": F.sum, "max": F.max, "first": F.first}[self.fn](self.column).over(inclusive)

    def total(self, position: Column, reverse: bool) -> Column:
        """Partial of one segment."""
        if self.fn == "sum":
            return F.sum(self.column)
        if self.fn in ("max", "max_before"):
            return F.max(self.column)
        earliest, latest = (F.max_by, F.min_by) if reverse else (F.min_by, F.max_by)
        if self.fn == "last":
            position = F.when(self.column.isNotNull(), position)
        return (earliest if self.fn == "first" else latest)(self.column, position)

    def carried(self, partial: Column, before) -> Column:
        """Partials of the segments before, folded into one value."""
        if self.fn == "sum":
            return F.sum(partial).over(before)
        if self.fn in ("max", "max_before"):
            return F.max(partial).over(before)
        fold = F.first if self.fn == "first" else F.last
        return fold(partial, ignorenulls=True).over(before)

    def combine(self, carry: Column, own: Column) -> Column:
        if self.fn == "sum":
            return F.coalesce(carry + own, carry, own)
        if self.fn in ("max", "max_before"):
            return F.greatest(carry, own)
        return F.coalesce(carry, own) if self.fn == "first" else F.coalesce(own, carry)


def partials(df: DataFrame, keys: list[str], order: list[str], values: list[Running], reverse: bool = False) -> DataFrame:
    """One partial row per key: what later rows of the key need to know about these rows."""
    position = F.struct(*order)
    return df.groupBy(*keys).agg(*[v.total(position, reverse).alias(v.name) for v in values])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[Running],
    reverse: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running ``values`` per ``keys`` along ``order``; segmented when ``df`` has segments.

    The partials read the rows once more. ``source`` names a cheaper table holding the same rows
    with the columns needed, so that a chain of running values does not recompute itself.
    """
    segmented = SEGMENT in df.columns
    parts = keys + [SEGMENT] if segmented else keys
    direction = [F.col(c).desc() if reverse else F.col(c) for c in order]
    window = Window.partitionBy(*parts).orderBy(*direction)
    if not segmented:
        return df.select("*", *[v.over_rows(window).alias(v.name) for v in values])
    step = F.col(SEGMENT).desc() if reverse else F.col(SEGMENT)
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    own = partials(df if source is None else source, parts, order, values, reverse)
    carried = own.select(*parts, *[v.carried(F.col(v.name), earlier).alias(f"_carry_{v.name}") for v in values])
    joined = df.join(carried, parts, "left")
    results = [v.combine(F.col(f"_carry_{v.name}"), F.col(f"_own_{v.name}")).alias(v.name) for v in values]
    return joined.select("*", *[v.over_rows(window).alias(f"_own_{v.name}") for v in values]).select(
        *[F.col(c) for c in df.columns], *results
    )


def add_segments(
    df: DataFrame,
    keys: list[str],
    position: str,
    unit: int,
    rows_per_segment: int,
) -> DataFrame:
    """Cut each key along ``position`` into segments of about ``rows_per_segment`` rows.

    Counts per key and ``unit`` of position are reduced on the map side; a segment never splits a
    unit, so rows with equal positions stay together.
    """
    bucket = F.expr(f"{position} div {unit}")
    counted = df.withColumn("_unit", bucket)
    so_far = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        counted.groupBy(*keys, "_unit")
        .count()
        .withColumn("_before", F.sum("count").over(so_far))
        .select(
            *keys,
            "_unit",
            F.expr(f"coalesce(_before, 0) div {rows_per_segment}").alias(SEGMENT),
        )
    )
    return counted.join(cuts, keys + ["_unit"]).drop("_unit")


def hot_keys(df: DataFrame, key: str, ts_us: str, max_rows: int, max_rows_per_week: int) -> DataFrame:
    """Keys whose rows, in all or within a week, are too many for one task's plain window."""
    weekly = df.groupBy(key, F.expr(f"{ts_us} div {S.WEEK}").alias("_week")).count()
    return (
        weekly.groupBy(key)
        .agg(F.sum("count").alias("_rows"), F.max("count").alias("_peak"))
        .where((F.col("_rows") > max_rows) | (F.col("_peak") > max_rows_per_week))
        .select(key)
    )


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, int]:
    """Hint a broadcast only after counting; a larger table keeps the shuffled join."""
    rows = df.limit(max_rows + 1).count()
    return (F.broadcast(df) if rows <= max_rows else df), rows
