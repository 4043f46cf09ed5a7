"""The account graph, kept as group membership instead of an edge list.

Two accounts are neighbours if they share a customer, or if they share a tier and both have a 6 h
ratio above one half. Both relations are complete within a group, so the groups are the graph: sizes,
degrees and neighbour means follow from group totals. No pair of accounts is ever built, and work
grows with the number of accounts, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scaling import Scaler

# Fixed value: 6 h ratio from which accounts of one tier are linked.
COORDINATED_RATIO = 0.5


def members(accounts: DataFrame, coordinated: bool = True) -> DataFrame:
    """Accounts with their two groups: ``customer_group`` and ``tier_group`` (null if not linked)."""
    owner = F.when(
        F.coalesce("customer_id", F.lit("")) == "", F.concat(F.lit("account/"), "account_id")
    ).otherwise(F.concat(F.lit("customer/"), "customer_id"))
    tier = F.when(F.col("max_cross_ratio_6h") > COORDINATED_RATIO, F.col("tier_numeric").cast("int"))
    return accounts.withColumn("customer_group", owner).withColumn(
        "tier_group", tier if coordinated else F.lit(None).cast("int")
    )


def group_totals(nodes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Node rows with totals of the customer group, the tier group and their intersection."""
    cells = nodes.groupBy("customer_group", "tier_group").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    names = ["_n", *sums]
    totals = lambda key, prefix: cells.groupBy(key).agg(*[F.sum(c).alias(f"{prefix}{c}") for c in names])
    by_customer = totals("customer_group", "c")
    by_tier = totals("tier_group", "t").where(F.col("tier_group").isNotNull())
    both = cells.where(F.col("tier_group").isNotNull()).select(
        "customer_group", "tier_group", *[F.col(c).alias(f"b{c}") for c in names]
    )
    joined = nodes.join(by_customer, "customer_group")
    # The tier groups are as many as the tier codes: four.
    joined = joined.join(F.broadcast(by_tier), "tier_group", "left")
    return joined.join(both, ["customer_group", "tier_group"], "left")


def united(name: str) -> Column:
    """Total over the union of both groups, the node itself included once."""
    optional = lambda prefix: F.coalesce(F.col(f"{prefix}{name}"), F.lit(0))
    return F.col(f"c{name}") + optional("t") - optional("b")


def degrees(nodes: DataFrame) -> DataFrame:
    """Neighbours per account: by customer, by tier, by either, and edges with the self-loop."""
    t = group_totals(nodes, {})
    return t.select(
        "account_id", "customer_group", "tier_group",
        (F.col("c_n") - 1).alias("customer_neighbours"),
        F.coalesce(F.col("t_n") - 1, F.lit(0)).alias("tier_neighbours"),
        (united("_n") - 1).alias("neighbours"),
        united("_n").alias("edges_out"),
    )


def graph_stats(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Node, edge and class counts; multi-account customers; number of features, whether any is missing or NaN,
    and the largest absolute value of a feature after scaling."""
    largest = F.greatest(*[F.max(F.abs(e)) for e in Scaler.fit(nodes, columns).expressions()])
    missing = F.bool_or(F.greatest(*[(F.isnan(F.col(c)) | F.col(c).isNull()).cast("int") for c in columns]) == 1)
    base = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("label") == 1).alias("suspicious_nodes"),
        F.count_if(F.col("label") == 0).alias("normal_nodes"), largest.alias("max_feature_value"),
        F.lit(len(columns)).alias("features"), F.coalesce(missing, F.lit(False)).alias("has_nan"),
    )
    edges = degrees(nodes).agg(F.sum("edges_out").cast("bigint").alias("edges"))
    groups = nodes.groupBy("customer_group").count().where(F.col("count") > 1)
    shared = groups.agg(
        F.count("*").alias("multi_account_customers"),
        F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)), F.lit(0)).alias("shared_customer_edges"),
    )
    one = F.lit(1).alias("_one")
    # Three one-row tables side by side.
    return (
        base.withColumn("_one", one).join(edges.withColumn("_one", one), "_one")
        .join(shared.withColumn("_one", one), "_one").drop("_one")
    )


def neighbor_mean(nodes: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Mean of each column over the neighbours and, by the self-loop, the node itself."""
    t = group_totals(nodes, {f"_{c}": F.col(c) for c in columns})
    n = united("_n")
    return t.select(*nodes.columns, *[(united(f"_{c}") / n).alias(f"mean_{c}{suffix}") for c in columns])
