"""The customer-month rollup fed by a stream.

Each micro-batch is cleaned and rolled up on its own, and its rows replace the
folder of its batch id in the store. A batch that is replayed after a failure
writes the same folder again, so the store holds every batch once. Customer-months
of different batches add up when the store is read.

Exact copies of a row are removed within a micro-batch; a source that can send a
copy twice must keep copies in one file (a file is never cut across batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions import columns as C
from recurra.operators import clean as CL
from recurra.operators import rollup as RU


def write_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Idempotent by batch id: the batch's folder is replaced whole."""
    RU.customer_month(CL.clean(batch)).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def run(spark: SparkSession, source: str, schema: T.StructType, store: str, files_per_batch: int) -> str:
    """Rolls all available files of raw facts into the store; returns it."""
    facts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (facts.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, store))
             .option("checkpointLocation", f"{store}-progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return store


def merged(spark: SparkSession, store: str) -> DataFrame:
    """The customer-month rollup over all batches (the columns that add up)."""
    rows = spark.read.parquet(store)
    sums = [F.sum(c).alias(c) for c in ("paying_amt", "refund_abs", "positive_amt", "n_rows", "n_raw_rows", "n_zero", "n_negative")]
    ever = [F.bool_or(c).alias(c) for c in ("is_paying", "has_active_status", "has_churned", "has_past_due")]
    return rows.groupBy(*RU.CM_KEYS).agg(*sums, *ever, F.max("max_paying_row").alias("max_paying_row"),
                                         F.min("currency_min").alias("currency_min"), F.max("currency_max").alias("currency_max"))


def monthly(cm: DataFrame) -> DataFrame:
    """A5 from the merged rollup: (tenant_id, period, mrr, active); tenants that mix currencies are left out."""
    allowed = cm.join(CL.blocked_tenants(cm), "tenant_id", "left_anti")
    paying = allowed.where(F.col("is_paying") & F.col("period_idx").isNotNull())
    return paying.groupBy("tenant_id", C.period_label(F.col("period_idx")).alias("period")).agg(
        F.sum("paying_amt").cast("double").alias("mrr"), F.count(F.lit(1)).alias("active"))
