"""Revenue, growth, retention and health metrics.

``metrics_by_month`` evaluates every month that has paying rows as if it
were the reference's ``last_month`` with the data truncated at that month.
``metrics_last`` is the slice at each tenant's most recent paying month,
which is exactly what the reference reports for one export.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions import columns as C
from recurra.functions.constants import (
    LTV_CAP_MONTHS, MIN_PAYING_FOR_QUALIFIED_MONTH, NRR_MAX, NRR_MIN, NRR_WARNING)
from recurra.operators import rollup
from recurra.operators.clean import blocked_tenants

METRIC_COLUMNS = [
    "mrr", "arr", "arpu", "total_revenue",
    "new_mrr", "reactivation_mrr", "growth_rate", "new_subscribers", "reactivated_subscribers",
    "churn_rate", "voluntary_churn_rate", "involuntary_churn_rate", "revenue_churn", "nrr",
    "nrr_warning", "ltv", "active_subscribers", "lost_subscribers", "existing_subscribers",
    "mrr_prev_month", "active_subscribers_prev_month", "expansion_mrr",
]
CONTEXT_COLUMNS = ["last_month", "last_month_is_fallback", "prev_month", "prev_month_status"]


class Rollup:
    """The shared intermediate tables of one metrics job.

    ``hist`` (one row per customer-month with its window facts) is read by
    the month aggregation, the reactivation check and the cohorts. With
    ``materialize=True`` it is written once to the shared folder, so the
    fact table is scanned, de-duplicated and shuffled exactly once however
    many outputs are derived; the small tenant-month table likewise.

    ``hist`` has every tenant (the cleaning report counts them all);
    ``allowed`` leaves out tenants that mix currencies, which are refused
    before any metric. All other tables derive from it.

    ``subs`` may be given in parts that share no customer; each is grouped on its own.
    """

    def __init__(self, subs: DataFrame | list[DataFrame], materialize: bool = False):
        parts = subs if isinstance(subs, list) else [subs]
        months = [rollup.customer_month(p) for p in parts]
        subs = self.subs = reduce(DataFrame.unionByName, parts)
        self.materialized = materialize
        self._tables: dict[str, DataFrame] = {}
        self.cm = reduce(DataFrame.unionByName, months)
        hist = reduce(DataFrame.unionByName, map(rollup.customer_history, months))
        if materialize:
            from recurra.session import materialize as _mat
            spark = subs.sparkSession
            hist = _mat(spark, hist, "customer_history", "zstd")
            self.blocked = _mat(spark, blocked_tenants(hist), "blocked_tenants")
        else:
            self.blocked = blocked_tenants(hist)
        self.hist = hist
        self.allowed = hist.join(self.blocked, "tenant_id", "left_anti")
        base = rollup.tenant_month_base(self.allowed)
        self.base = _mat(spark, base, "tenant_month_base") if materialize else base

    def table(self, name: str, build) -> DataFrame:
        """A derived table of this rollup, built once (and written to the
        shared folder when the rollup is materialized)."""
        if name not in self._tables:
            df = build(self)
            if self.materialized:
                from recurra.session import materialize as _mat
                df = _mat(self.subs.sparkSession, df, name)
            self._tables[name] = df
        return self._tables[name]

    def by_month(self) -> DataFrame:
        return self.table("metrics_by_month", metrics_by_month)

    def last(self) -> DataFrame:
        return self.table("metrics_last", lambda r: metrics_last(r, r.by_month()))


def _d(col):
    return col.cast("double")


def metrics_by_month(r: Rollup) -> DataFrame:
    """All metrics for every (tenant, month with paying rows)."""
    base = r.base
    undated = (base.where(F.col("period_idx").isNull())
               .select("tenant_id", F.col("positive").alias("undated_positive")))
    dated = base.where(F.col("period_idx").isNotNull())
    by_tenant = Window.partitionBy("tenant_id").orderBy("period_idx")
    with_cum = dated.withColumn(
        "cum_positive", F.sum("positive").over(by_tenant.rowsBetween(Window.unboundedPreceding, 0)))
    months = with_cum.where(F.col("n_paying") > 0)
    months = months.withColumn(
        "prev_paying_month", F.lag("period_idx").over(by_tenant))

    mrr = _d(F.col("mrr"))
    prev_mrr = _d(F.col("prev_mrr"))
    arpu = F.when(F.col("n_paying") > 0, mrr / F.col("n_paying")).otherwise(F.lit(0.0))
    ok = F.col("n_prev_paying") > 0
    status = (F.when(ok, F.lit("ok"))
               .when(F.col("prev_paying_month").isNotNull(), F.lit("gap"))
               .otherwise(F.lit("missing")))
    m = months.select(
        "tenant_id", "period_idx", "n_paying", "n_active_status", "n_new", "new_mrr",
        "refund_b", "n_prev_paying", "prev_mrr", "n_lost", "churn_a", "n_vol", "n_invol",
        "n_existing", "expansion", "cum_positive", "mrr",
        arpu.alias("arpu"), status.alias("prev_month_status"))

    react = rollup.reactivations(r.allowed, m.select("tenant_id", "period_idx", "arpu"))
    m = (m.join(react, ["tenant_id", "period_idx"], "left")
          .join(undated, "tenant_id", "left"))

    okc = F.col("prev_month_status") == "ok"
    mrr = _d(F.col("mrr"))
    prev_mrr = _d(F.col("prev_mrr"))
    churn = F.when(okc & (F.col("n_prev_paying") > 0), F.col("n_lost") / F.col("n_prev_paying") * 100)
    vol = F.when(okc & (F.col("n_prev_paying") > 0), F.col("n_vol") / F.col("n_prev_paying") * 100)
    invol = F.when(okc & (F.col("n_prev_paying") > 0), F.col("n_invol") / F.col("n_prev_paying") * 100)
    rev_churn = F.when(okc, _d(F.col("churn_a") + F.col("refund_b"))).otherwise(F.lit(0.0))
    raw_nrr = (mrr - rev_churn) / prev_mrr * 100
    nrr = F.when(okc & (prev_mrr != 0), F.least(F.greatest(raw_nrr, F.lit(NRR_MIN)), F.lit(NRR_MAX)))
    arpu_c = F.col("arpu")
    ltv = F.when(F.col("churn_rate").isNull() | (F.col("churn_rate") == 0), arpu_c * LTV_CAP_MONTHS) \
           .otherwise(arpu_c / (F.col("churn_rate") / 100))

    out = m.select(
        "tenant_id", "period_idx",
        C.period_label(F.col("period_idx")).alias("period"),
        mrr.alias("mrr"),
        (mrr * 12).alias("arr"),
        "arpu",
        _d(F.col("cum_positive") + F.coalesce("undated_positive", F.lit(0).cast(C.MONEY))).alias("total_revenue"),
        _d(F.col("new_mrr")).alias("new_mrr"),
        F.coalesce(_d(F.col("reactivation_mrr_dec")), F.lit(0.0)).alias("reactivation_mrr"),
        F.when(okc & (prev_mrr != 0), (mrr - prev_mrr) / prev_mrr * 100).alias("growth_rate"),
        F.col("n_new").cast("long").alias("new_subscribers"),
        F.coalesce("reactivated_subscribers", F.lit(0)).cast("long").alias("reactivated_subscribers"),
        churn.alias("churn_rate"),
        vol.alias("voluntary_churn_rate"),
        invol.alias("involuntary_churn_rate"),
        rev_churn.alias("revenue_churn"),
        nrr.alias("nrr"),
        F.col("n_active_status").cast("long").alias("active_subscribers"),
        F.when(okc, F.col("n_lost")).cast("long").alias("lost_subscribers"),
        F.when(okc, F.col("n_existing")).otherwise(F.lit(0)).cast("long").alias("existing_subscribers"),
        F.when(okc, prev_mrr).alias("mrr_prev_month"),
        F.when(okc, F.col("n_prev_paying")).cast("long").alias("active_subscribers_prev_month"),
        F.when(okc, _d(F.col("expansion"))).alias("expansion_mrr"),
        F.col("period_idx").alias("last_month_idx"),
        (F.col("n_paying") < MIN_PAYING_FOR_QUALIFIED_MONTH).alias("last_month_is_fallback"),
        "prev_month_status",
        F.col("n_paying").cast("long").alias("paying_customers"),
    )
    out = out.withColumn("nrr_warning", F.coalesce(F.col("nrr") > NRR_WARNING, F.lit(False)))
    out = out.withColumn("ltv", ltv)
    return out


def metrics_last(r: Rollup, bym: DataFrame | None = None) -> DataFrame:
    """H5 ``get_all_metrics`` for every tenant: the last paying month's row.

    Total revenue covers every row of the tenant (any date, NULL included).
    Tenants without any paying row get the reference's empty-data values.
    """
    bym = metrics_by_month(r) if bym is None else bym
    last = Window.partitionBy("tenant_id")
    latest = (bym.withColumn("_max", F.max("period_idx").over(last))
                 .where(F.col("period_idx") == F.col("_max")).drop("_max", "total_revenue"))
    totals = r.base.groupBy("tenant_id").agg(_d(F.sum("positive")).alias("total_revenue"))
    joined = totals.join(latest, "tenant_id", "left")
    zero_if_none = {"mrr": 0.0, "arr": 0.0, "arpu": 0.0, "new_mrr": 0.0, "reactivation_mrr": 0.0,
                    "revenue_churn": 0.0, "ltv": 0.0}
    cols = ["tenant_id", F.col("period").alias("last_month")]
    for c in METRIC_COLUMNS:
        if c in zero_if_none:
            cols.append(F.coalesce(F.col(c), F.lit(zero_if_none[c])).alias(c))
        elif c in ("new_subscribers", "reactivated_subscribers", "active_subscribers", "existing_subscribers"):
            cols.append(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c))
        elif c == "nrr_warning":
            cols.append(F.coalesce(F.col(c), F.lit(False)).alias(c))
        else:
            cols.append(F.col(c))
    cols += [F.coalesce("last_month_is_fallback", F.lit(True)).alias("last_month_is_fallback"),
             C.period_label(F.col("period_idx") - 1).alias("prev_month"),
             F.coalesce("prev_month_status", F.lit("missing")).alias("prev_month_status")]
    return joined.select(*cols)


def _last_months(r: Rollup) -> DataFrame:
    return (r.last().where(F.col("last_month").isNotNull())
                    .select("tenant_id", C.label_to_idx(F.col("last_month")).alias("period_idx"), "arpu"))


def new_customers(r: Rollup) -> DataFrame:
    """Customers whose first row (any status, any amount) falls in the
    tenant's last month."""
    lm = _last_months(r)
    h = r.allowed.where(F.col("period_idx") == F.col("first_seen_idx")).select("tenant_id", "customer_id", "period_idx")
    return h.join(lm.select("tenant_id", "period_idx"), ["tenant_id", "period_idx"]).select("tenant_id", "customer_id")


def new_customers_by_month(r: Rollup) -> DataFrame:
    """G3 with every paying month as the last one."""
    months = r.base.where(F.col("period_idx").isNotNull() & (F.col("n_paying") > 0)).select("tenant_id", "period_idx")
    h = r.allowed.where(F.col("period_idx") == F.col("first_seen_idx")).select("tenant_id", "customer_id", "period_idx")
    return h.join(months, ["tenant_id", "period_idx"]).select(
        "tenant_id", "customer_id", C.period_label(F.col("period_idx")).alias("period"))


def reactivated_customers(r: Rollup) -> DataFrame:
    """Customers reactivated in the tenant's last month."""
    rows = rollup.reactivated_rows(r.allowed, _last_months(r))
    return rows.select("tenant_id", "customer_id", C.money(F.col("paying_amt")).cast("double").alias("mrr"))


def churn_type(r: Rollup) -> DataFrame:
    """K3: churn sets in the last month: any 'churned' row -> voluntary; any
    'past_due' row without a 'churned' row -> involuntary."""
    lm = _last_months(r).select("tenant_id", "period_idx")
    h = r.allowed.join(lm, ["tenant_id", "period_idx"]).where(F.col("has_churned") | F.col("has_past_due"))
    return h.select("tenant_id", "customer_id",
                    F.when(F.col("has_churned"), F.lit("voluntary")).otherwise(F.lit("involuntary")).alias("churn_type"))
