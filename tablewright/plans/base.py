"""Registration of queries with their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Catalog, Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL for the same rows if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema as models with references."""
    t = lambda name: table(spark, sf_dir, name)
    return {
        "region": Table(t("region"), "r_regionkey"),
        "nation": Table(t("nation"), "n_nationkey", {"n_regionkey": "region"}),
        "customer": Table(t("customer"), "c_custkey", {"c_nationkey": "nation"}),
        "supplier": Table(t("supplier"), "s_suppkey", {"s_nationkey": "nation"}),
        "part": Table(t("part"), "p_partkey"),
        "orders": Table(t("orders"), "o_orderkey", {"o_custkey": "customer"}),
        "lineitem": Table(t("lineitem"), "l_orderkey", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    }


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer as an object and their lines as a list of objects; some values null."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag")).alias("flag"), F.col("l_quantity").alias("qty")).alias("line"))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("day"),
        F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("status")).alias("customer"),
    )
    return orders.join(lists, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey")


#: The same in SQL, with the flags of an order's lines.
REPORTS = """
WITH lines AS (
  SELECT l_orderkey, list(CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END) AS flags, list(l_quantity) AS qtys FROM lineitem GROUP BY l_orderkey
), r AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, o_totalprice AS price, o_orderdate::DATE AS day,
    o_custkey AS key, o_orderpriority AS prio, flags, qtys
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
)
"""
