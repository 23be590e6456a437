"""customer_month rollup and the per-customer window stage.

Shuffle plan (fact table of any size):

0. De-duplication (in ``clean``) hashes whole rows: a hot customer or
   customer-month is spread over every task; copies are dropped map-side.
1. ``customer_month``: one grouped aggregate of the clean facts keyed by
   (tenant, customer, month). Partial aggregation runs map-side, so even a
   customer holding a third of all rows is collapsed to at most
   (#months x #map tasks) rows before the exchange.
2. ``customer_history``: one window stage partitioned by (tenant, customer)
   over the rolled-up rows (at most one row per customer-month). It yields
   every per-customer fact the metrics need (first-seen month, cohort,
   previous paying month, running max payment, neighbour months).
3. Metrics aggregate that to (tenant, month); everything above the rollup is
   small and AQE chooses broadcast only from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import columns as C

CM_KEYS = ["tenant_id", "customer_id", "period_idx"]


def customer_month(subs: DataFrame) -> DataFrame:
    """One row per (tenant, customer, month); NULL month holds undated rows."""
    paying = C.is_paying()
    amt = C.money(F.col("amount"))
    return (subs.groupBy(*CM_KEYS).agg(
        F.sum(F.when(paying, amt)).alias("paying_amt"),
        F.count_if(paying).alias("n_paying_rows"),
        F.max(F.when(paying, F.col("amount"))).alias("max_paying_row"),
        F.count_if(F.col("status") == "active").alias("n_active_status"),
        F.count_if(F.col("status") == "churned").alias("n_churned"),
        F.count_if(F.col("status") == "past_due").alias("n_past_due"),
        F.sum(F.when(F.col("amount") < 0, -amt)).alias("refund_abs"),
        F.sum(F.when(F.col("amount") > 0, amt)).alias("positive_amt"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum("n_copies") if "n_copies" in subs.columns else F.count(F.lit(1))).alias("n_raw_rows"),
        F.count_if(F.col("amount") == 0).alias("n_zero"),
        F.count_if(F.col("amount") < 0).alias("n_negative"),
        F.min("currency").alias("currency_min"),
        F.max("currency").alias("currency_max"),
    ).select(
        *CM_KEYS,
        F.coalesce("paying_amt", F.lit(0).cast(C.MONEY)).alias("paying_amt"),
        (F.col("n_paying_rows") > 0).alias("is_paying"),
        (F.col("n_active_status") > 0).alias("has_active_status"),
        (F.col("n_churned") > 0).alias("has_churned"),
        (F.col("n_past_due") > 0).alias("has_past_due"),
        F.coalesce("refund_abs", F.lit(0).cast(C.MONEY)).alias("refund_abs"),
        F.coalesce("positive_amt", F.lit(0).cast(C.MONEY)).alias("positive_amt"),
        "max_paying_row", "n_rows", "n_raw_rows", "n_zero", "n_negative", "currency_min", "currency_max",
    ))


def customer_history(cm: DataFrame) -> DataFrame:
    """Per-customer window facts over the rolled-up rows (NULL month first)."""
    by_cust = Window.partitionBy("tenant_id", "customer_id")
    ordered = by_cust.orderBy(F.col("period_idx").asc_nulls_first())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pay_idx = F.when(F.col("is_paying"), F.col("period_idx"))
    # Only the columns later stages read are kept (the table is materialized).
    return cm.select(
        "tenant_id", "customer_id", "period_idx", "paying_amt", "is_paying", "has_active_status",
        "has_churned", "has_past_due", "refund_abs", "positive_amt",
        "n_rows", "n_raw_rows", "n_zero", "n_negative", "currency_min", "currency_max",
        F.min("period_idx").over(by_cust).alias("first_seen_idx"),
        F.min(pay_idx).over(by_cust).alias("cohort_idx"),
        F.last(pay_idx, ignorenulls=True).over(before).alias("prev_pay_idx"),
        F.max("max_paying_row").over(upto).alias("run_max_paying_row"),
        F.lag("period_idx").over(ordered).alias("lag_idx"),
        F.lag("is_paying").over(ordered).alias("lag_paying"),
        F.lead("period_idx").over(ordered).alias("lead_idx"),
        F.lead("is_paying").over(ordered).alias("lead_paying"),
        F.lead("has_active_status").over(ordered).alias("lead_active_status"),
        F.lead("has_churned").over(ordered).alias("lead_churned"),
        F.lead("has_past_due").over(ordered).alias("lead_past_due"),
        F.lead("paying_amt").over(ordered).alias("lead_paying_amt"),
    )


def _contributions(hist: DataFrame) -> DataFrame:
    """Each customer-month row feeds its own month and (if paying) the next.

    The "current" record carries what month m needs from the customer's row
    at m; the "previous" record carries what month m+1 needs from the
    customer's row at m (prev-month base, lost, churn split, expansion).
    One pass: the two records are produced with ``inline`` (no re-scan).
    """
    zero = F.lit(0).cast(C.MONEY)
    idx = F.col("period_idx")
    paying = F.col("is_paying")
    prev_is_last = F.coalesce((F.col("lag_idx") == idx - 1) & F.col("lag_paying"), F.lit(False))
    in_churned_set = prev_is_last & ~F.col("has_active_status")
    next_adjacent = F.coalesce(F.col("lead_idx") == idx + 1, F.lit(False))
    nxt = lambda c: F.coalesce(next_adjacent & F.col(c), F.lit(False))
    is_new = F.coalesce(F.col("first_seen_idx") == idx, F.lit(False))

    def rec(k, **vals):
        fields = {
            "k": k,
            "n_paying": F.lit(0), "mrr": zero, "n_active_status": F.lit(0),
            "n_new": F.lit(0), "new_mrr": zero, "refund_b": zero, "positive": zero,
            "n_prev_paying": F.lit(0), "prev_mrr": zero, "n_lost": F.lit(0),
            "churn_a": zero, "n_vol": F.lit(0), "n_invol": F.lit(0),
            "n_existing": F.lit(0), "expansion": zero,
        }
        fields.update(vals)
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    as_int = lambda b: b.cast("int")
    cur = rec(
        idx,
        n_paying=as_int(paying),
        mrr=F.col("paying_amt"),
        n_active_status=as_int(F.col("has_active_status")),
        n_new=as_int(is_new),
        new_mrr=F.when(is_new, F.col("paying_amt")).otherwise(zero),
        refund_b=F.when(in_churned_set, zero).otherwise(F.col("refund_abs")),
        positive=F.col("positive_amt"),
    )
    stays_paying = nxt("lead_paying")
    prev = rec(
        idx + 1,
        n_prev_paying=F.lit(1),
        prev_mrr=F.col("paying_amt"),
        n_lost=as_int(~stays_paying),
        churn_a=F.when(nxt("lead_active_status"), zero).otherwise(F.col("paying_amt")),
        n_vol=as_int(nxt("lead_churned")),
        n_invol=as_int(nxt("lead_past_due") & ~nxt("lead_churned")),
        n_existing=as_int(stays_paying),
        expansion=F.when(stays_paying, F.greatest(F.col("lead_paying_amt") - F.col("paying_amt"), zero))
                   .otherwise(zero),
    )
    recs = F.when(paying & idx.isNotNull(), F.array(cur, prev)).otherwise(F.array(cur))
    return hist.select("tenant_id", F.inline(recs))


def tenant_month_base(hist: DataFrame) -> DataFrame:
    """Sums per (tenant, month) of all contributions; NULL month = undated."""
    contrib = _contributions(hist)
    sums = [F.sum(c).alias(c) for c in [
        "n_paying", "mrr", "n_active_status", "n_new", "new_mrr", "refund_b", "positive",
        "n_prev_paying", "prev_mrr", "n_lost", "churn_a", "n_vol", "n_invol",
        "n_existing", "expansion"]]
    return contrib.groupBy("tenant_id", F.col("k").alias("period_idx")).agg(*sums)


def reactivated_rows(hist: DataFrame, arpu_by_month: DataFrame) -> DataFrame:
    """G6 per customer-month: paying now, last paid 3-10 months earlier
    (2-9 months absent), and not an annual plan (largest paying row so far
    above 6 x ARPU of the month)."""
    from recurra.functions.constants import (
        ANNUAL_PLAN_ARPU_MULTIPLE, REACTIVATION_MAX_ABSENT, REACTIVATION_MIN_ABSENT)
    gap = F.col("period_idx") - F.col("prev_pay_idx") - 1
    cand = (hist.where(F.col("is_paying") & F.col("period_idx").isNotNull()
                       & gap.between(REACTIVATION_MIN_ABSENT, REACTIVATION_MAX_ABSENT))
                .select("tenant_id", "customer_id", "period_idx", "paying_amt", "run_max_paying_row"))
    joined = cand.join(arpu_by_month.select("tenant_id", "period_idx", "arpu"), ["tenant_id", "period_idx"])
    return joined.where(~((F.col("arpu") > 0)
                          & (F.col("run_max_paying_row") > F.lit(ANNUAL_PLAN_ARPU_MULTIPLE) * F.col("arpu"))))


def reactivations(hist: DataFrame, arpu_by_month: DataFrame) -> DataFrame:
    """G7/G8 per (tenant, month): count and MRR of reactivated customers."""
    kept = reactivated_rows(hist, arpu_by_month)
    return kept.groupBy("tenant_id", "period_idx").agg(
        F.count(F.lit(1)).alias("reactivated_subscribers"),
        F.sum("paying_amt").alias("reactivation_mrr_dec"))
