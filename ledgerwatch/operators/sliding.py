"""Sliding windows over a customer's transactions: the last 60 s, 1 h, 6 h, 24 h and 7 d.

Three plans give the same columns: counts ``n_*``, sums ``s_*`` in kobo, and for 24 h the largest
amount, the spread, the number of round amounts and the number of own accounts used.

* ``ordinary``: range frames, for customers with a bounded number of rows per window.
* ``busy``: a sweep for customers with very many rows. Every row enters once and leaves once per
  window length, so each window value is a running sum that can be cut into segments.
* ``by_arrival``: arrival order, where later event times may have arrived already. Ranks are split
  dyadically: a row is data for the right half of a block and asks the left half, once per level,
  so n rows cost n log n and no pair of rows is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..session import cut_lineage
from .prefix import SEGMENT, Running, add_segments, running

LENGTHS = {"60s": S.MINUTE, "1h": S.HOUR, "6h": 6 * S.HOUR, "24h": S.DAY, "7d": S.WEEK}
COUNTS = ("60s", "1h", "24h")
SUMS = ("1h", "6h", "24h", "7d")
NOTHING = -(1 << 62)


def amount() -> Column:
    return F.col("amount_minor")


def count(n: int) -> Column:
    return F.lit(n).cast("bigint")


def squared(value: Column) -> Column:
    wide = value.cast("decimal(19,0)")
    return wide * wide


def round_flag() -> Column:
    return X.flag(X.is_round_amount()).cast("bigint")


def ordinary(df: DataFrame) -> DataFrame:
    """Range frames end one microsecond before the row; rows of the same instant are added in
    arrival order. Both windows and the running ones before share one shuffle and one sort."""
    peers = (
        Window.partitionBy("customer_id", "ts_us")
        .orderBy("arrival_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = {
        name: Window.partitionBy("customer_id").orderBy("ts_us").rangeBetween(-length, -1)
        for name, length in LENGTHS.items()
    }
    day = before["24h"]
    df = df.withColumn("_round", round_flag()).select(
        "*",
        F.count("*").over(peers).alias("_pn"),
        F.sum(amount()).over(peers).alias("_ps"),
        F.max(amount()).over(peers).alias("_pmax"),
        F.avg(amount()).over(peers).alias("_pavg"),
        F.stddev_pop(amount()).over(peers).alias("_pstd"),
        F.sum("_round").over(peers).alias("_pround"),
        F.collect_set("account_id").over(peers).alias("_paccounts"),
    )
    df = df.select(
        "*",
        *[F.count("*").over(before[w]).alias(f"_n_{w}") for w in COUNTS],
        *[F.coalesce(F.sum(amount()).over(before[w]), count(0)).alias(f"_s_{w}") for w in SUMS],
        F.max(amount()).over(day).alias("_max"),
        F.avg(amount()).over(day).alias("_avg"),
        F.stddev_pop(amount()).over(day).alias("_std"),
        F.coalesce(F.sum("_round").over(day), count(0)).alias("_rounds"),
        F.collect_set("account_id").over(day).alias("_accounts"),
    )
    n1, n2 = F.col("_n_24h"), F.col("_pn")
    n = n1 + n2
    gap = F.coalesce(F.col("_avg") - F.col("_pavg"), F.lit(0.0))
    variance = (
        n1 * F.pow(F.coalesce("_std", F.lit(0.0)), 2) + n2 * F.pow("_pstd", 2)
    ) / n + n1 * n2 * gap * gap / (n * n)
    temporary = [c for c in df.columns if c.startswith(("_p", "_n_", "_s_")) and c != "_previous_us"]
    return df.select(
        "*",
        *[(F.col(f"_n_{w}") + F.col("_pn")).alias(f"n_{w}") for w in COUNTS],
        *[(F.col(f"_s_{w}") + F.col("_ps")).alias(f"s_{w}") for w in SUMS],
        F.lit(None).cast("decimal(38,0)").alias("q_24h"),
        (F.sqrt(variance) / 100.0).alias("std_24h"),
        F.greatest("_max", "_pmax").alias("max_24h"),
        (F.col("_rounds") + F.col("_pround")).alias("round_24h"),
        F.size(F.array_union("_accounts", "_paccounts")).cast("bigint").alias("accounts_24h"),
    ).drop(*temporary, "_max", "_avg", "_std", "_rounds", "_accounts", "_round")


def busy(df: DataFrame, rows_per_segment: int) -> DataFrame:
    """The sweep. Needs event-time order; every step works on segments."""
    row_columns = [c for c in df.columns if c != SEGMENT]
    rows = df.withColumn("_block", X.floor_div("ts_us", S.DAY))
    # Largest amount of the same 24 h block after this row: what remains once the row has left.
    rows = running(
        rows, ["customer_id", "_block"], ["ts_us", "arrival_seq"],
        [Running("_later", "max_before", amount())], reverse=True,
    )
    windows = list(LENGTHS)
    moves = [F.struct(F.col("ts_us").alias("t"), F.lit(2).alias("kind"), F.lit("in").alias("move"))] + [
        F.struct((F.col("ts_us") + LENGTHS[w] + 1).alias("t"), F.lit(1).alias("kind"), F.lit(w).alias("move"))
        for w in windows
    ]
    steps = (
        rows.withColumn("_move", F.explode(F.array(*moves)))
        .select(
            "customer_id", "account_id", "arrival_seq", amount(), round_flag().alias("_round"),
            "_block", "_later", F.col("_move.*"),
            F.when(F.col("_move.move") == "in", F.struct(*row_columns)).alias("_row"),
        )
    )
    # At the start of a block nothing of the block before has left yet.
    markers = rows.groupBy("customer_id", "_block").agg(F.max(amount()).alias("_later")).select(
        "customer_id", "_block", "_later",
        ((F.col("_block") + 1) * S.DAY).alias("t"), F.lit(0).alias("kind"), F.lit("mark").alias("move"),
    )
    steps = steps.unionByName(markers, allowMissingColumns=True)
    enters, leaves_day = F.col("move") == "in", F.col("move") == "24h"
    steps = steps.withColumn("arrival_seq", F.coalesce("arrival_seq", F.lit(-1))).withColumn(
        "_block", F.when(enters, F.col("_block")).otherwise(F.col("_block") + 1)
    )
    steps = cut_lineage(add_segments(steps, ["customer_id"], "t", S.MINUTE, rows_per_segment))
    moved = steps
    order = ["t", "kind", "arrival_seq"]

    def change(window: str, value: Column) -> Column:
        return F.when(enters, value).when(F.col("move") == window, -value).otherwise(value * 0)

    steps = running(
        steps, ["customer_id", "account_id"], order,
        [Running("_active", "sum", F.coalesce(change("24h", count(1)), count(0)))],
        source=moved,
    )
    started = enters & (F.col("_active") == 1)
    stopped = leaves_day & (F.col("_active") == 0)
    steps = running(
        steps, ["customer_id", "_block"], order,
        [
            Running("_so_far", "max", F.when(enters, amount())),
            Running(
                "_remaining", "last",
                F.when(leaves_day | (F.col("move") == "mark"), F.coalesce("_later", F.lit(NOTHING))),
            ),
        ],
        source=moved,
    )
    value = F.coalesce(amount(), count(0))
    steps = running(
        steps, ["customer_id"], order,
        [Running(f"n_{w}", "sum", change(w, count(1))) for w in COUNTS]
        + [Running(f"s_{w}", "sum", change(w, value)) for w in SUMS]
        + [
            Running("q_24h", "sum", change("24h", squared(value))),
            Running("round_24h", "sum", change("24h", F.coalesce("_round", count(0)))),
            Running("accounts_24h", "sum", F.when(started, count(1)).when(stopped, -count(1)).otherwise(count(0))),
        ],
    )
    return steps.where(enters).select(
        F.col("_row.*"),
        *[f"n_{w}" for w in COUNTS], *[f"s_{w}" for w in SUMS],
        F.col("q_24h").cast("decimal(38,0)").alias("q_24h"),
        F.lit(None).cast("double").alias("std_24h"),
        F.greatest("_so_far", "_remaining").alias("max_24h"),
        "round_24h", "accounts_24h",
    )


def by_arrival(df: DataFrame, rows_per_segment: int | None = None) -> DataFrame:
    """Exact windows for any arrival order. ``df`` holds all rows a window may reach, with their
    place in the customer's arrivals among these rows as ``_place`` (from one)."""
    # An account is in the window if its newest event time so far is. Only a new maximum matters:
    # it takes the place of the account's previous maximum.
    df = running(df, ["customer_id", "account_id"], ["arrival_seq"],
                 [Running("_newest", "max_before", F.col("ts_us"))])
    columns = [c for c in df.columns if c not in (SEGMENT, "_newest", "_place")]
    record = F.col("_newest").isNull() | (F.col("ts_us") > F.col("_newest"))
    narrow = df.select(
        "customer_id", "amount_minor", "ts_us", "_newest", (F.col("_place") - 1).alias("_rank"),
        round_flag().alias("_round"), record.alias("_record"), F.struct(*columns).alias("_row"),
    )
    if rows_per_segment:
        narrow = cut_lineage(narrow)
        narrow = narrow.join(narrow.groupBy("customer_id").agg(F.max("_rank").alias("_last")), "customer_id")
    else:
        narrow = narrow.withColumn("_last", F.max("_rank").over(Window.partitionBy("customer_id")))

    # Level -1 is the row itself: it is in its own window and carries the other columns along.
    higher = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("_last"), F.lit(1)))).cast("int"))
    levels = F.when(F.col("_last") > 0, F.concat(F.array(F.lit(-1)), higher)).otherwise(F.array(F.lit(-1)))
    itself = F.col("_level") < 0
    split = narrow.withColumn("_level", F.explode(levels)).select(
        *[F.when(itself, F.col(c)).alias(c) if c == "_row" else F.col(c) for c in narrow.columns],
        "_level",
        F.when(itself, F.col("_rank")).otherwise(F.expr("shiftright(_rank, _level + 1)")).alias("_half"),
        F.when(itself, False).otherwise(F.expr("shiftright(_rank, _level) & 1") == 1).alias("_asks"),
    )
    point = lambda us, kind, window, present, accounts: F.struct(
        (-us).alias("u"), F.lit(kind).alias("kind"), F.lit(window).alias("window"),
        present.alias("present"), accounts.alias("accounts"),
    )
    own_account = X.flag(F.col("_record")) - X.flag(F.col("_record") & (F.col("_newest") >= F.col("ts_us") - S.DAY))
    own = F.array(point(F.col("ts_us"), 1, "all", count(1), own_account.cast("bigint")))
    questions = F.array(*[point(F.col("ts_us") - h, 1, w, count(0), count(0)) for w, h in LENGTHS.items()])
    entry = point(F.col("ts_us"), 0, "", count(1), F.col("_record").cast("bigint"))
    replaced = point(F.col("_newest"), 0, "", count(0), -count(1))
    answers = F.when(F.col("_record") & F.col("_newest").isNotNull(), F.array(entry, replaced)).otherwise(F.array(entry))
    # A left half only has work where its right half exists.
    useful = itself | F.col("_asks") | (F.expr("shiftleft(shiftright(_rank, _level) + 1, _level)") <= F.col("_last"))
    points = (
        split.where(useful)
        .withColumn("_point", F.explode(F.when(itself, own).when(F.col("_asks"), questions).otherwise(answers)))
        .select("customer_id", "_level", "_half", "_rank", amount(), "_round", "_row", F.col("_point.*"))
    )
    keys = ["customer_id", "_level", "_half"]
    if rows_per_segment:
        points = cut_lineage(add_segments(points, keys, "u", S.MINUTE, rows_per_segment))
    present = F.col("present")
    points = running(
        points, keys, ["u", "kind", "_rank"],
        [
            Running("n", "sum", present),
            Running("s", "sum", present * amount()),
            Running("q", "sum", present * squared(amount())),
            Running("rounds", "sum", present * F.col("_round")),
            Running("used", "sum", F.col("accounts")),
            Running("largest", "max", F.when(present == 1, amount())),
        ],
    )
    within = lambda window, column: F.when(F.col("window").isin(window, "all"), F.col(column))
    gathered = points.where("kind = 1").groupBy("customer_id", "_rank").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        *[F.sum(within(w, "n")).alias(f"n_{w}") for w in COUNTS],
        *[F.sum(within(w, "s")).alias(f"s_{w}") for w in SUMS],
        F.sum(within("24h", "q")).cast("decimal(38,0)").alias("q_24h"),
        F.max(within("24h", "largest")).alias("max_24h"),
        F.sum(within("24h", "rounds")).alias("round_24h"),
        F.sum(within("24h", "used")).alias("accounts_24h"),
    )
    return gathered.select(
        "_row.*", *[f"n_{w}" for w in COUNTS], *[f"s_{w}" for w in SUMS], "q_24h",
        F.lit(None).cast("double").alias("std_24h"), "max_24h", "round_24h", "accounts_24h",
    )
