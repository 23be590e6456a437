"""Cohort retention.

Entry into a cohort needs a paying row (first paying month); retention in
month n only needs any ``status='active'`` row in cohort+n (amount ignored).
All inputs come from the customer_month/customer_history rollup, which has at
most one row per customer-month, so plain counts are distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import columns as C
from recurra.functions.constants import COHORT_MAX_SHOWN, COHORT_MIN_COUNT, COHORT_PDF_SHOWN


def cohort_assignment(hist: DataFrame) -> DataFrame:
    """B1: first paying month per customer (one row per paying customer)."""
    return (hist.where(F.col("period_idx") == F.col("cohort_idx"))
                .select("tenant_id", "customer_id", "cohort_idx",
                        C.period_label(F.col("cohort_idx")).alias("cohort")))


def cohort_selection(hist: DataFrame, max_shown: int = COHORT_MAX_SHOWN) -> DataFrame:
    """B2: the latest ``max_shown`` cohorts of tenants with >= 3 cohorts."""
    sizes = cohort_assignment(hist).groupBy("tenant_id", "cohort_idx").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("tenant_id").orderBy(F.col("cohort_idx").desc())
    ranked = (sizes.withColumn("cohort_rank", F.row_number().over(w))
                   .withColumn("n_cohorts", F.count(F.lit(1)).over(Window.partitionBy("tenant_id"))))
    return (ranked.where((F.col("n_cohorts") >= COHORT_MIN_COUNT) & (F.col("cohort_rank") <= max_shown))
                  .select("tenant_id", "cohort_idx", C.period_label(F.col("cohort_idx")).alias("cohort"),
                          F.col("size").cast("long").alias("size"), "cohort_rank"))


def cohort_retention(hist: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Retained customers per (cohort, month_n) for the shown cohorts."""
    shown = cohort_selection(hist) if shown is None else shown
    active = hist.where(F.col("has_active_status") & F.col("period_idx").isNotNull()
                        & (F.col("period_idx") >= F.col("cohort_idx")))
    joined = active.join(shown.select("tenant_id", "cohort_idx"), ["tenant_id", "cohort_idx"])
    return (joined.groupBy("tenant_id", "cohort_idx",
                           (F.col("period_idx") - F.col("cohort_idx")).alias("month_n"))
                  .agg(F.count(F.lit(1)).cast("long").alias("retained")))


def cohort_grid(hist: DataFrame, max_shown: int = COHORT_MAX_SHOWN) -> DataFrame:
    """Dense grid, one horizon H per tenant, unseen cells 0.0.

    H = latest active-status month of any shown-cohort customer minus the
    earliest shown cohort. ``pct`` is half-even rounded to one decimal;
    ``pct_exact`` keeps the unrounded share; ``is_observed`` marks cells not
    after the latest active month.
    """
    shown = cohort_selection(hist, max_shown)
    ret = cohort_retention(hist, shown)
    # Latest active month among shown-cohort customers, per tenant.
    latest = (ret.groupBy("tenant_id")
                 .agg(F.max(F.col("cohort_idx") + F.col("month_n")).alias("max_active_idx")))
    spans = (shown.groupBy("tenant_id").agg(F.min("cohort_idx").alias("min_cohort"))
                  .join(latest, "tenant_id")
                  .withColumn("horizon", F.col("max_active_idx") - F.col("min_cohort")))
    grid = (shown.join(spans, "tenant_id")
                 .withColumn("month_n", F.explode(F.sequence(F.lit(0), F.col("horizon")))))
    cells = grid.join(ret, ["tenant_id", "cohort_idx", "month_n"], "left")
    share = F.coalesce(F.col("retained"), F.lit(0)) / F.col("size") * 100
    return cells.select(
        "tenant_id", "cohort", "cohort_idx", "size", "cohort_rank", "month_n",
        F.coalesce("retained", F.lit(0).cast("long")).alias("retained"),
        F.bround(share, 1).alias("pct"),
        share.alias("pct_exact"),
        ((F.col("cohort_idx") + F.col("month_n")) <= F.col("max_active_idx")).alias("is_observed"),
    )


def cohort_table(grid: DataFrame, horizon: int) -> DataFrame:
    """Wide table (cohort, size, month_0..month_H) via a pivot on an
    explicit value list (no extra distinct job)."""
    wide = (grid.groupBy("tenant_id", "cohort", "size")
                .pivot("month_n", list(range(horizon + 1)))
                .agg(F.first("pct")))
    return wide.select("tenant_id", "cohort", "size",
                       *[F.col(str(n)).alias(f"month_{n}") for n in range(horizon + 1)])


def cohort_top_k(grid: DataFrame, k: int = COHORT_PDF_SHOWN) -> DataFrame:
    """The latest k shown cohorts (report sections use 12 and 8)."""
    return grid.where(F.col("cohort_rank") <= k)
