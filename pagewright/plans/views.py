"""Catalog tables over the test tables, as DataFrames and as the same SQL.

Both sides read the same mapping: customers are runs, orders sessions, parts
records and details, line items prices, suppliers sellers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

URL = "concat('https://', lower(substr(o_orderpriority, 1, 1)), '.example.com/', o_orderstatus, '/')"
SESSIONS = f"SELECT o_orderkey AS id, o_custkey AS run_id, o_orderpriority AS domain, o_orderstatus AS locale, {URL} AS url, CAST(o_totalprice AS BIGINT) AS found_count, o_orderdate AS start_time FROM orders"
RUNS = "SELECT c_custkey AS id, c_mktsegment AS scheduler_id FROM customer"
PRICES = "SELECT l_partkey AS record_id, l_extendedprice AS price, l_orderkey AS session_id, l_linenumber AS line, l_shipdate AS date_created FROM lineitem"
FIRST = "SELECT l_partkey, l_orderkey AS session_id, l_shipdate AS date_created FROM (SELECT l_partkey, l_orderkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) AS x WHERE k = 1"
RECORDS = f"""
SELECT p_partkey AS id, concat('part_', CAST(p_partkey AS VARCHAR(20))) AS alias, p_name AS title, p_brand AS make, p_type AS model,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1990 + p_size % 30 END AS year,
       CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 1000 END AS mileage,
       CASE WHEN p_size % 9 = 0 THEN NULL ELSE concat('/p/', CAST(p_partkey AS VARCHAR(20))) END AS link,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('img/', CAST(p_partkey AS VARCHAR(20))) END AS image_link,
       session_id, date_created,
       CASE WHEN p_size % 4 = 0 THEN date_created + INTERVAL '30' DAY END AS date_sold
FROM part JOIN ({FIRST}) AS f ON l_partkey = p_partkey"""
DETAILS = """
SELECT p_partkey + 1000000 AS id, p_partkey AS record_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 10 + 1 END AS seller_id,
       2000 + p_size % 20 AS year, p_size * 777 AS mileage,
       CASE WHEN p_size % 6 = 0 THEN '' ELSE 'petrol' END AS fuel_type, CASE WHEN p_size % 8 = 0 THEN NULL ELSE 'manual' END AS transmission,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('R', CAST(p_partkey AS VARCHAR(20))) END AS registration_number,
       CASE WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 0 THEN NULL ELSE concat('V', CAST(p_partkey AS VARCHAR(20))) END AS vin_number,
       CAST(NULL AS VARCHAR(20)) AS sdk, TIMESTAMP '1998-01-01 00:00:00' AS date_created
FROM part WHERE p_partkey % 3 <> 0"""
SELLERS = "SELECT s_suppkey AS id, s_name AS name FROM supplier"
HISTORY = "SELECT event_type AS url, value AS found_count, ts AS end_time FROM events"

#: Name, SQL, and the test tables that it reads.
VIEWS = {
    "runs": (RUNS, ["customer"]),
    "sessions": (SESSIONS, ["orders"]),
    "prices": (PRICES, ["lineitem"]),
    "records": (RECORDS, ["part", "lineitem"]),
    "details": (DETAILS, ["part"]),
    "sellers": (SELLERS, ["supplier"]),
    "history": (HISTORY, ["events"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The catalog table, its test tables read by path."""
    sql, tables = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def with_views(sql: str) -> str:
    """The same tables for DuckDB, in front of a query."""
    used = [n for n in VIEWS if f" {n}" in sql or f"\n{n}" in sql or f"({n}" in sql]
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in used) + " " if used else "") + sql



def price_order() -> list:
    """Latest price first, ties fully broken."""
    return [F.desc("date_created"), F.desc("session_id"), F.desc("line"), F.desc("price")]


PRICE_ORDER_SQL = "date_created DESC, session_id DESC, line DESC, price DESC"
