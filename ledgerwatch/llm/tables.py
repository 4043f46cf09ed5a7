"""Reading the tables and small helpers around data frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


SMALL_SIDE = 100_000  # rows of a join's side that may go to every executor


def side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join, of at most ``rows`` rows: few go to every executor, more are shuffled.

    Spark's own guess would be taken from compressed files and takes no notice of an explode, so it may send a large table
    through the driver."""
    return F.broadcast(df) if rows <= SMALL_SIDE else df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(name: str):
    """A column by its plain name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
