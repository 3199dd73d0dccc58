"""Panels over the given tables, in Spark and as SQL subqueries, and one rounding for both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwatch.config import PanelSpec
from panelwatch.functions.exprs import ratio

ORDERS = PanelSpec("o_custkey", ("o_totalprice",), "o_orderdate", ("o_orderkey",))
EVENTS = PanelSpec("user_id", ("value",), "ts", ("event_id",), period="cast(date_trunc('day', ts) as timestamp_ntz)")
EVENTS_BY_HOUR = PanelSpec(
    "user_id", ("value",), "ts", ("event_id",), period="cast(date_trunc('hour', ts) as timestamp_ntz)"
)
CUSTOMERS = PanelSpec("c_nationkey", ("c_acctbal",), None, ("c_custkey",))
SUPPLIER_MONTH = PanelSpec("l_suppkey", ("quantity_change", "price_change"), "month")
VECTORS = PanelSpec("label", ("x0",), None, ("vec_id",), label="odd")
COMPONENTS = [f"x{i}" for i in range(64)]

SUPPLIER_MONTH_SQL = """
    SELECT l_suppkey, month,
           quantity / nullif(lag(quantity) OVER w, 0) - 1 AS quantity_change,
           price / nullif(lag(price) OVER w, 0) - 1 AS price_change
    FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS month,
                 sum(l_quantity) AS quantity, sum(l_extendedprice) AS price
          FROM lineitem GROUP BY ALL)
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "value")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


def vector_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as a panel of 64 columns; an odd label is taken as the truth."""
    columns = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)]
    return table(spark, folder, "embeddings").select("vec_id", "label", *columns, (F.col("label") % 2).alias("odd"))


def supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    """Month-on-month changes per supplier; a supplier has at most one row per month, so its window stays short."""
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")
    totals = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", month)
        .agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    )
    w = Window.partitionBy("l_suppkey").orderBy("month")
    return totals.select(
        "l_suppkey",
        "month",
        (ratio(F.col("quantity"), F.lag("quantity").over(w)) - 1).alias("quantity_change"),
        (ratio(F.col("price"), F.lag("price").over(w)) - 1).alias("price_change"),
    )


def single(c: Column) -> Column:
    """A double at the precision of a float: the last bits depend on the order of additions on either side."""
    return F.round(c, 8).cast("float").cast("double") + F.lit(0.0)


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[single(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def num(expression: str, name: str | None = None) -> str:
    """The SQL twin of ``single``."""
    return f"CAST(CAST(round({expression}, 8) AS FLOAT) AS DOUBLE) + 0.0 AS {name or expression}"


def nums(*names: str) -> str:
    return ", ".join(num(n) for n in names)
