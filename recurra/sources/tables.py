"""Driver tables -> canonical billing facts.

The reference ingests one billing export per user. Here the same canonical
columns are derived from the TPC-H-like driver tables so that every metric
job reads real, scalable input:

* ``tenant_id``   = ``c_mktsegment`` (one "file" per market segment)
* ``customer_id`` = ``string(o_custkey)``
* ``date``        = ``l_shipdate``
* ``amount``      = extended price net of discount, half-up to cents, computed
  in integer cents so every engine gets the same value; negated for
  returned-and-final lines (refunds), zero for non-returned lines with a
  discount below 1 % (zero-amount rows)
* ``status``      = raw export spelling: ``Active``; pending orders become
  ``cancelled`` (open line) or ``Payment Failed`` (final line)
* ``currency``    = ``USD``, but ``EUR`` for the HOUSEHOLD customers whose
  nation key is divisible by 5 (so that tenant mixes currencies)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def net_amount_cents(price: str = "l_extendedprice", discount: str = "l_discount"):
    cents = F.round(F.col(price) * 100).cast("long")
    disc_pct = F.round(F.col(discount) * 100).cast("long")
    return F.floor((cents * (F.lit(100) - disc_pct) + 50) / 100).cast("long")


def raw_billing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical-named raw rows (status still in export spelling).

    Carries ``src_order``/``src_line`` as the ingest ordinal (file order).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")

    # Orders meet their customers first: the fact rows are joined (and shuffled) once, by order.
    owned = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = li.join(owned, li.l_orderkey == owned.o_orderkey)
    net = net_amount_cents()
    signed_cents = (F.when((F.col("l_returnflag") == "N") & (F.col("l_discount") < 0.01), F.lit(0))
                     .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), -net)
                     .otherwise(net))
    raw_status = (F.when(F.col("o_orderstatus") != "P", F.lit("Active"))
                   .when(F.col("l_linestatus") == "O", F.lit("cancelled"))
                   .otherwise(F.lit("Payment Failed")))
    return joined.select(
        F.col("c_mktsegment").alias("tenant_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("date"),
        (signed_cents.cast("double") / F.lit(100.0)).alias("amount"),
        raw_status.alias("status"),
        F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_nationkey") % 5 == 0), F.lit("EUR"))
         .otherwise(F.lit("USD")).alias("currency"),
        F.col("l_orderkey").alias("src_order"),
        F.col("l_linenumber").alias("src_line"),
    )


# SQL (DuckDB) form of the same derivation, used by the oracle queries.
RAW_BILLING_SQL = """
raw AS (
  SELECT c.c_mktsegment AS tenant_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CAST(l.l_shipdate AS TIMESTAMP) AS date,
         CAST(CASE WHEN l.l_returnflag = 'N' AND l.l_discount < 0.01 THEN 0
                   WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F'
                        THEN -((CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT)) + 50) // 100)
                   ELSE (CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT)) + 50) // 100
              END AS DOUBLE) / 100.0 AS amount,
         CASE WHEN o.o_orderstatus <> 'P' THEN 'active'
              WHEN l.l_linestatus = 'O' THEN 'churned'
              ELSE 'past_due' END AS status,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' AND c.c_nationkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
         l.l_orderkey AS src_order,
         l.l_linenumber AS src_line
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
)"""
