"""Label reports, ordered splits, exact order statistics and classification metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import Running, add_segments, running


def label_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("is_suspicious").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # two rows
    return counts.withColumn("pct", F.round(share, 4))


SKETCH = 4096  # size of a quantile sketch: ranks are off by about a thousandth of the rows
MARGIN = 2.0  # times the sketch's usual error


def order_statistics(
    df: DataFrame, column: str, ranks: list[int] | Callable[[int], list[int]], k: int = SKETCH, small: int = 20_000
) -> list[float]:
    """Exact values at the given 1-based ranks of ``column``, or at those that a function gives for the number of rows.

    One pass takes a mergeable quantile sketch, which brackets all ranks at once; a second one counts what lies between the brackets
    and each value within them. Only if more than ``small`` different values lie within, further sketches narrow the brackets first:
    each leaves a few thousandths of the rows. A rank outside its bracket, which the counts would tell, is looked for in the gap.
    """
    integral = isinstance(df.schema[column].dataType, (T.IntegralType,))
    kind = "bigint" if integral else "double"
    v = F.col("v")
    values = df.select(F.col(column).cast(kind).alias("v")).where(v.isNotNull())
    sketch = getattr(F, f"kll_sketch_agg_{kind}")
    real = F.lit(True) if integral else ~F.isnan(v)
    known = F.when(real, v)
    rows, numbers, low, high, data = _scan(values.agg(F.count("*"), F.count(known), F.min(known), F.max(known), sketch(known, k)))[0]
    wanted = ranks(rows) if callable(ranks) else ranks
    for rank in wanted:
        if not 1 <= rank <= rows:
            raise ValueError(f"rank {rank} of {rows} rows")
    found: dict[int, float] = {r: math.nan for r in wanted if r > numbers}  # NaN is larger than any number
    values = values.where(real)
    todo = _brackets(df.sparkSession, {r: (low, high, 0, numbers, data) for r in wanted if r <= numbers}, kind, k)
    while todo:
        edges = _joined(todo.values())
        segment = F.lit(2 * len(edges))
        for j, (lo, hi) in reversed(list(enumerate(edges))):
            segment = F.when(v < F.lit(lo), 2 * j).when(v <= F.lit(hi), 2 * j + 1).otherwise(segment)
        counts = values.select(segment.alias("s"), "v").groupBy("s", F.when(F.col("s") % 2 == 1, v).alias("v")).count()
        most = max(small, 16) + len(edges) + 1
        held = _scan(counts.limit(most + 1))
        if len(held) > most:
            todo = _narrower(values, todo, edges, (low, high), kind, k)
            continue
        before, at = 0, {}
        for row in sorted(held, key=lambda r: (r["s"], r["v"] is not None, r["v"] if r["v"] is not None else 0)):
            for rank in todo:
                if before < rank <= before + row["count"]:
                    at[rank] = row["s"], row["v"]
            before += row["count"]
        found |= {r: value for r, (s, value) in at.items() if s % 2}
        todo = {r: (edges[s // 2 - 1][1] if s else low, edges[s // 2][0] if s // 2 < len(edges) else high) for r, (s, _) in at.items() if not s % 2}
    return [found[r] for r in wanted]


def _scan(df: DataFrame) -> list:
    """Rows of a pass over the data; a bounded number."""
    return df.collect()


def _brackets(spark: SparkSession, ranks: dict[int, tuple], kind: str, k: int) -> dict[int, tuple]:
    """Values around every rank, from (low, high, rows before, rows, sketch of them)."""
    off = MARGIN * 2.296 / k**0.9021  # the published error of this sketch, as a share of the rows
    quantile = getattr(F, f"kll_sketch_get_quantile_{kind}")
    out, asked = {}, {}
    for rank, (low, high, before, rows, data) in ranks.items():
        place = (rank - before) / rows
        asked[rank] = quantile(F.lit(bytes(data)), F.array(F.lit(max(0.0, place - off - 1 / rows)), F.lit(min(1.0, place + off))))
        out[rank] = low, high, place - off - 1 / rows <= 0, place + off >= 1
    if not asked:
        return {}
    found = spark.range(1).select(*[c.alias(f"r{i}") for i, c in enumerate(asked.values())]).first()
    return {r: (out[r][0] if out[r][2] else pair[0], out[r][1] if out[r][3] else pair[1]) for r, pair in zip(asked, found)}


def _joined(brackets) -> list[tuple]:
    """Brackets in order, overlapping ones as one."""
    edges: list[tuple] = []
    for lo, hi in sorted(brackets):
        if edges and lo <= edges[-1][1]:
            edges[-1] = edges[-1][0], max(edges[-1][1], hi)
        else:
            edges.append((lo, hi))
    return edges


def _narrower(values: DataFrame, todo: dict[int, tuple], edges: list[tuple], ends: tuple, kind: str, k: int) -> dict[int, tuple]:
    """Brackets from sketches of what lies within the present ones."""
    v, sketch = F.col("v"), getattr(F, f"kll_sketch_agg_{kind}")
    aggregates = []
    for lo, hi in edges:
        inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
        aggregates += [F.count_if(v < F.lit(lo)), F.count_if(inside), sketch(F.when(inside, v), k)]
    found = _scan(values.agg(*aggregates))[0]
    out, known = {}, {}
    for rank, (low, _) in todo.items():
        j = next(i for i, (lo, hi) in enumerate(edges) if lo <= low <= hi)
        before, rows, data = found[3 * j : 3 * j + 3]
        if before < rank <= before + rows:
            known[rank] = (*edges[j], before, rows, data)
        else:
            out[rank] = (ends[0], edges[j][0]) if rank <= before else (edges[j][1], ends[1])
    return out | _brackets(values.sparkSession, known, kind, k)


def percentile(df: DataFrame, column: str, fraction: float) -> float:
    """Exact percentile with linear interpolation between neighbouring ranks, in two passes."""
    place = lambda n: fraction * (n - 1)
    rows = []

    def ranks(n: int) -> list[int]:
        rows.append(n)
        return [int(place(n)) + 1, min(int(place(n)) + 2, n)]

    a, b = order_statistics(df, column, ranks)
    return a + (b - a) * (place(rows[0]) - int(place(rows[0])))


def temporal_split(df: DataFrame, fraction: float = 0.75, column: str = "arrival_seq") -> DataFrame:
    """Add ``split``: the first part of the rows by arrival is train, the rest test.

    The cut is found in two passes, then applied as a filter: no row is sorted or moved.
    """
    last = order_statistics(df, column, lambda n: [int(n * fraction)] if int(n * fraction) else [])
    if not last:
        return df.withColumn("split", F.lit("test"))
    return df.withColumn("split", F.when(F.col(column) <= F.lit(last[0]), "train").otherwise("test"))


def node_split(accounts: DataFrame, fraction: float = 0.75) -> DataFrame:
    """The same split of accounts by first appearance."""
    return temporal_split(accounts, fraction, "first_seq")


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Counts and the usual ratios; a ratio with nothing to divide by is zero."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def average_precision(
    df: DataFrame, label: str, score: str, resolution: int = 1_000_000, rows_per_segment: int = 200_000
) -> DataFrame:
    """Area under precision and recall as a step sum over distinct scores, highest first.

    Distinct scores may be as many as the rows, so the running counts are segmented along the score.
    """
    points = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("hits")
    ).withColumns({"_all": F.lit(1), "_place": -F.floor(F.col("s") * resolution)})
    cut = add_segments(points, ["_all"], "_place", max(resolution // 4096, 1), rows_per_segment)
    cut = cut.withColumn("_down", -F.col("s"))
    steps = running(cut, ["_all"], ["_down"], [Running("_n", "sum", F.col("n")), Running("_hits", "sum", F.col("hits"))])
    gained = F.sum(F.col("hits") * (F.col("_hits") / F.col("_n")))
    return steps.agg((gained / F.sum("hits")).alias("average_precision"))


def class_weights(df: DataFrame, label: str = "is_suspicious", cap: float = 10.0) -> dict[str, float]:
    """Balanced weight per class, and the capped weight of the suspicious class for the graph model."""
    normal, suspicious = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    total = normal + suspicious
    return {
        "normal": total / (2.0 * normal) if normal else 0.0,
        "suspicious": total / (2.0 * suspicious) if suspicious else 0.0,
        "graph_suspicious": min(normal / suspicious, cap) if suspicious else cap,
    }


def class_weight_table(df: DataFrame, label: str = "is_suspicious", cap: float = 10.0) -> DataFrame:
    """The same as a table: one row per class."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    two = Window.partitionBy(F.lit(1))  # two rows
    normal = F.sum(F.when(F.col("label") == 0, F.col("n"))).over(two)
    graph = F.when(F.col("label") == 0, 1.0).otherwise(F.least(normal / F.col("n"), F.lit(cap)))
    return counts.select(
        "label", "n", (F.sum("n").over(two) / (2.0 * F.col("n"))).alias("balanced_weight"), graph.alias("graph_weight")
    )
