"""Mixing sources to target weights: repetition rates per source, then whole copies and one hash-seeded draw.

Defined results: a null text has size 0; null is a source of its own, last in order. The draw depends on the id and
the seed alone, so reruns agree, rows with one id are drawn alike, and a null id counts as the text ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import column, free_name

SMALL = 10_000  # sources: up to so many rows go to every executor, more are joined by shuffle
STEPS = 1 << 52


def size_of(text: Column) -> Column:
    """Number of words: runs of bytes outside 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def rates(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size): ``weights`` go round the sources in order of code points.

    Targets are total * all sizes * weight share, but ``most`` times the source's size at most; what is cut goes
    to the rest by weight until none is above. The level at which that ends is found from running sums over
    the sources in order of most * size / weight: one row per source, so one task is enough.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * F.lit(most)
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    # The first source that the level doesn't fill sets it for all behind; those before are full.
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < cap)
    found = found.withColumn("set", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.coalesce(F.col("set") * F.col("weight"), cap.cast("double"))
    return found.select("source", "source_size", target.alias("target"))


def copies(key: Column, rate: Column, seed: str = "") -> Column:
    """floor(rate) and one more with probability rate - floor(rate), drawn from a hash of id and seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))
    drawn = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(STEPS))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def with_rates(rows: DataFrame, per_source: DataFrame, source: str) -> DataFrame:
    """Adds source_size and target. Sources are few as a rule: counted, then sent to all or joined by shuffle."""
    of = free_name(rows, "_of")
    per_source = cut_lineage(per_source).withColumnRenamed("source", of)
    side = F.broadcast(per_source) if per_source.count() <= SMALL else per_source
    return rows.join(side, column(source).eqNullSafe(F.col(of))).drop(of)


def mix_sizes(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target of its source, and the words that the mix takes of it, repeats counted."""
    sized = cut_lineage(docs.select(column(key).alias("id"), F.col("source"), size_of(F.col("text")).alias("size")))
    found = with_rates(sized, rates(sized, **options), "source")
    taken = F.col("size") * F.when(F.col("source_size") > 0, copies(F.col("id"), F.col("target") / F.col("source_size"))).otherwise(0)
    return found.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it; same columns. Sources without words go."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size"))
    inner = docs.select("*", F.col("source").alias(free_name(docs, "_source")))
    source = inner.columns[-1]
    per_source = rates(sizes, **options).select("source", F.try_divide("target", "source_size").alias(free_name(docs, "_rate")))
    rate = per_source.columns[-1]
    found = with_rates(inner, per_source, source).where(F.col(rate) > 0)
    return found.withColumn(source, F.explode(F.array_repeat(F.lit(1), copies(column(key), F.col(rate)).cast("int")))).select(*map(column, docs.columns))
