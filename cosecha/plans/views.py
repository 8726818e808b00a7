"""The engine's star schema as DataFrames over the driver's tables, and the same schema as SQL for the oracles.

Departments, cities and markets are regions, nations and suppliers; products, categories
and subcategories are parts, their types and brands. Facts are built from line items.
Prices stay exact decimals: means are taken as a double sum over a count at the edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that trailing windows end on, so that every scale factor agrees.
AS_OF = "2001-11-05"


@dataclass(frozen=True)
class Views:
    """The tables that operators read; each reads only the columns that a query uses."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def departments(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("department_id"), F.col("r_name").alias("department_name"))

    @cached_property
    def cities(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("n_regionkey").alias("department_id"))

    @cached_property
    def markets(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("market_id"), F.col("s_name").alias("market_name"), F.col("s_nationkey").alias("city_id"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_name"), F.col("p_brand").alias("subcategory_name"))

    @staticmethod
    def _price_columns() -> dict[str, Column]:
        high = F.col("l_extendedprice").cast("decimal(14,2)")
        low = high - (F.col("l_linenumber") * 10).cast("decimal(14,2)")
        return {
            "order_id": F.col("l_orderkey"),
            "line": F.col("l_linenumber"),
            "product_id": F.col("l_partkey"),
            "market_id": F.when(F.col("l_orderkey") % 19 != 0, F.col("l_suppkey")),
            "presentation_id": F.col("l_returnflag"),
            "units_id": F.col("l_linestatus"),
            "price_date": F.col("l_shipdate").cast("date"),
            "round": (1 + F.col("l_linenumber") % 2).cast("int"),
            "min_price": F.when(F.col("l_orderkey") % 7 != 0, low).cast("decimal(14,2)"),
            "max_price": F.when(F.col("l_orderkey") % 17 != 0, high).cast("decimal(14,2)"),
            "avg_price": F.when(F.col("l_linenumber") % 3 == 0, high - F.lit(5).cast("decimal(14,2)")).cast("decimal(14,2)"),
        }

    @cached_property
    def price_lines(self) -> DataFrame:
        """One row per price line: bounds and mean may each be null, and so may the market. Without the city, so without a join."""
        return self.table("lineitem").select(*(c.alias(n) for n, c in self._price_columns().items()))

    @cached_property
    def prices(self) -> DataFrame:
        """``price_lines`` with the city of the market."""
        line = self.table("lineitem").join(self.markets.select(F.col("market_id").alias("l_suppkey"), "city_id"), "l_suppkey")
        return line.select(*(c.alias(n) for n, c in self._price_columns().items()), "city_id")

    @cached_property
    def arrivals(self) -> DataFrame:
        """One row per arrival of a product at a market, without its origin: no join with orders and customers."""
        line = self.table("lineitem").join(self.markets.select(F.col("market_id").alias("l_suppkey"), "city_id"), "l_suppkey")
        return line.select(
            F.col("l_shipdate").cast("date").alias("observation_date"),
            F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_orderkey") % 19 != 0, F.col("l_suppkey")).alias("market_id"),
            "city_id",
            F.col("l_quantity").cast("decimal(14,2)").alias("quantity_kg"),
        )

    @cached_property
    def supply(self) -> DataFrame:
        """One row per arrival of a product at a market from an origin."""
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        orders = self.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
        line = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        line = line.join(self.markets.select(F.col("market_id").alias("l_suppkey"), "city_id"), "l_suppkey")
        origin = F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("n_name"))
        return line.select(
            F.col("l_shipdate").cast("date").alias("observation_date"),
            F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_orderkey") % 19 != 0, F.col("l_suppkey")).alias("market_id"),
            "city_id",
            origin.alias("origin"),
            F.col("l_quantity").cast("decimal(14,2)").alias("quantity_kg"),
        )

    @cached_property
    def input_prices(self) -> DataFrame:
        """Farm-input prices by month, department, city, article, brand and presentation."""
        line = self.table("lineitem").join(self.markets.withColumnRenamed("market_id", "l_suppkey"), "l_suppkey").join(self.cities, "city_id")
        line = line.join(self.products.withColumnRenamed("product_id", "l_partkey"), "l_partkey")
        return line.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("price_date"),
            "department_id",
            F.when(F.col("l_orderkey") % 23 != 0, F.col("city_id")).alias("city_id"),
            F.col("l_partkey").alias("input_id"),
            F.col("product_name").alias("article"),
            F.col("market_name").alias("brand"),
            F.col("subcategory_name").alias("cpc_code"),
            F.col("category_name").alias("subgroup"),
            F.col("l_returnflag").alias("presentation"),
            F.col("l_extendedprice").cast("decimal(14,2)").alias("avg_price"),
        )


#: The same views for DuckDB.
SQL_VIEWS = """
department AS (SELECT r_regionkey AS department_id, r_name AS department_name FROM region),
city AS (SELECT n_nationkey AS city_id, n_name AS city_name, n_regionkey AS department_id FROM nation),
market AS (SELECT s_suppkey AS market_id, s_name AS market_name, s_nationkey AS city_id FROM supplier),
product AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name, p_brand AS subcategory_name FROM part),
prices AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product_id,
    CASE WHEN l_orderkey % 19 <> 0 THEN l_suppkey END AS market_id, city_id,
    l_returnflag AS presentation_id, l_linestatus AS units_id, CAST(l_shipdate AS DATE) AS price_date,
    CAST(1 + l_linenumber % 2 AS INTEGER) AS round,
    CASE WHEN l_orderkey % 7 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) - CAST(l_linenumber * 10 AS DECIMAL(14,2)) AS DECIMAL(14,2)) END AS min_price,
    CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS max_price,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) - CAST(5 AS DECIMAL(14,2)) AS DECIMAL(14,2)) END AS avg_price
  FROM lineitem JOIN market ON l_suppkey = market.market_id),
supply AS (
  SELECT CAST(l_shipdate AS DATE) AS observation_date, l_partkey AS product_id,
    CASE WHEN l_orderkey % 19 <> 0 THEN l_suppkey END AS market_id, city_id,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN '' ELSE n_name END AS origin,
    CAST(l_quantity AS DECIMAL(14,2)) AS quantity_kg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN market ON l_suppkey = market.market_id),
input_prices AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(date_trunc('month', l_shipdate) AS DATE) AS price_date, department_id,
    CASE WHEN l_orderkey % 23 <> 0 THEN city.city_id END AS city_id, l_partkey AS input_id, product_name AS article,
    market_name AS brand, subcategory_name AS cpc_code, category_name AS subgroup, l_returnflag AS presentation,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS avg_price
  FROM lineitem JOIN market ON l_suppkey = market.market_id JOIN city ON market.city_id = city.city_id JOIN product ON l_partkey = product_id)
"""


def sql(body: str) -> str:
    """``body`` over the SQL views."""
    return f"WITH {SQL_VIEWS.strip()}\n{body.strip()}"


def sql_with(ctes: str, body: str) -> str:
    """``body`` over the SQL views and further common table expressions."""
    return f"WITH {SQL_VIEWS.strip()},\n{ctes.strip()}\n{body.strip()}"
