"""Entitlements: plan from sales (E1), plan lookup (R7), sales JSON (R8),
and feedback validation/history (S8, R6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions import columns as C
from recurra.functions.constants import PLAN_RANK, VALID_PLANS

SALE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("refunded", T.BooleanType()),
    T.StructField("chargedback", T.BooleanType()),
]))


def sales_from_json(df: DataFrame, user_col: str = "email", json_col: str = "sales_json") -> DataFrame:
    """Explode a landed JSON array of sales into one row per sale."""
    return (df.select(F.col(user_col).alias("email"), F.explode(F.from_json(json_col, SALE_SCHEMA)).alias("s"))
              .select("email", "s.product_id", "s.product_name",
                      F.coalesce("s.refunded", F.lit(False)).alias("refunded"),
                      F.coalesce("s.chargedback", F.lit(False)).alias("chargedback")))


def plan_from_sales(users: DataFrame, sales: DataFrame, pro_id: str, starter_id: str) -> DataFrame:
    """refunded/charged-back sales are ignored; pro beats starter beats
    free; users without a kept sale are free. One grouped pass (map-side
    partial max), then a left join from the user list."""
    rank = (F.when(F.col("product_id") == pro_id, F.lit(PLAN_RANK["pro"]))
             .when(F.col("product_id") == starter_id, F.lit(PLAN_RANK["starter"]))
             .otherwise(F.lit(PLAN_RANK["free"])))
    kept = sales.where(~F.col("refunded") & ~F.col("chargedback"))
    best = kept.groupBy("email").agg(F.max(rank).alias("rank"))
    names = F.create_map(*[x for p, r in PLAN_RANK.items() for x in (F.lit(r), F.lit(p))])
    return (users.select("email").distinct().join(best, "email", "left")
                 .select("email", F.coalesce(F.element_at(names, F.col("rank")), F.lit("free")).alias("plan")))


def plan_lookup(subscriptions: DataFrame) -> DataFrame:
    """One plan per email (first row by plan rank, then name); values
    outside the known plans read as 'free'."""
    valid = F.when(F.col("plan").isin(VALID_PLANS), F.col("plan")).otherwise(F.lit("free"))
    w = Window.partitionBy("email").orderBy(F.col("plan").asc_nulls_last())
    return (subscriptions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
                         .select("email", valid.alias("plan")))


def feedback_reason() -> Column:
    """Why a submission is refused, or NULL: it needs a rating or non-blank text; ratings are 1..5."""
    has_text = F.coalesce(F.length(C.strip(F.col("message"))) > 0, F.lit(False))
    return (F.when(F.col("rating").isNull() & ~has_text, F.lit("empty"))
             .when(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), F.lit("rating_out_of_range")))


def feedback_rejects(feedback: DataFrame) -> DataFrame:
    """The refused submissions with the reason."""
    return feedback.withColumn("reject_reason", feedback_reason()).where(F.col("reject_reason").isNotNull())


def feedback_accepted(feedback: DataFrame) -> DataFrame:
    """The rows that would be stored, text stripped (a filter on the reason: ids may be NULL or repeat)."""
    return feedback.where(feedback_reason().isNull()).withColumn("message", C.strip(F.col("message")))


def feedback_history(feedback: DataFrame) -> DataFrame:
    """Rating, message, created_at per user, newest first."""
    return (feedback_accepted(feedback)
            .select("user_email", "rating", "message", "created_at")
            .orderBy("user_email", F.col("created_at").desc()))
