"""What-if projection.

A scenario is (churn_reduction, new_customers_month, price_increase). Each
(tenant, scenario) pair is expanded to 12 month rows and every value is a
closed form of the month number, so no row depends on another row (no
window, no loop): with r = churn% x (1 - reduction), a = ARPU x (1 + price),
S0 = MRR / ARPU and g(n) = sum_{k<n} (1-r)^k,

    MRR(n) = max(0, S0 (1-r)^(n-1) a + N a g(n))

which is the month-by-month recurrence of the reference unrolled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.functions.constants import SIMULATION_CHURN_FALLBACK_PCT, SIMULATION_MONTHS, SIMULATION_RANGES

# Default what-if sets used by the registered report plans. These are user
# inputs (like the dashboard sliders), applied to every tenant's metrics.
DEFAULT_SCENARIOS = [
    ("baseline", 0.0, 0, 0.0),
    ("retention_push", 0.25, 0, 0.0),
    ("acquisition", 0.0, 10, 0.0),
    ("price_rise", 0.0, 0, 0.10),
    ("combined", 0.5, 5, 0.05),
    ("full_retention", 1.0, 0, 0.0),
    ("out_of_range", 1.5, 20000, 6.0),
]


def scenario_table(spark: SparkSession, rows=None) -> DataFrame:
    rows = DEFAULT_SCENARIOS if rows is None else rows
    return spark.createDataFrame(
        [(n, float(c), int(k), float(p)) for n, c, k, p in rows],
        "scenario string, churn_reduction double, new_customers_month long, price_increase double")


def _in_range(name: str) -> Column:
    lo, hi = SIMULATION_RANGES[name]
    return F.col(name).between(lo, hi)


def scenario_rejects(scen: DataFrame) -> DataFrame:
    """Parameter sets outside the dashboard's ranges, with the reason."""
    reasons = F.concat_ws(", ", *[F.when(~_in_range(n), F.lit(n)) for n in SIMULATION_RANGES])
    return scen.where(~(_in_range("churn_reduction") & _in_range("new_customers_month")
                        & _in_range("price_increase"))).withColumn("rejected_fields", reasons)


def rejects_by_tenant(metrics: DataFrame, rows=None) -> DataFrame:
    """P4 plus the ARPU guard: per tenant, the requested what-if sets that
    produce no projection and why (out-of-range inputs, zero ARPU)."""
    rows = DEFAULT_SCENARIOS if rows is None else rows
    inputs = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(c)).alias("churn_reduction"),
                                F.lit(int(k)).cast("long").alias("new_customers_month"),
                                F.lit(float(pr)).alias("price_increase"))
                       for n, c, k, pr in rows])
    t = metrics.select("tenant_id", "arpu", F.inline(inputs))
    out_of_range = [F.when(~_in_range(n), F.lit(n)) for n in SIMULATION_RANGES]
    reason = F.concat_ws(", ", *out_of_range, F.when(F.col("arpu") == 0, F.lit("zero_arpu")))
    return (t.select("tenant_id", "scenario", reason.alias("rejected_fields"))
             .where(F.col("rejected_fields") != ""))


def _geo(q: Column, n: Column, r: Column) -> Column:
    """sum_{k<n} q^k with q = 1 - r."""
    return F.when(r == 0, n.cast("double")).otherwise((1 - F.pow(q, n)) / r)


def _mrr_at(n: Column) -> Column:
    q = 1 - F.col("r")
    total = (F.col("s0") * F.pow(q, n - 1) * F.col("new_arpu")
             + F.col("new_customers_month") * F.col("new_arpu") * _geo(q, n, F.col("r")))
    return F.greatest(total, F.lit(0.0))


def _valid(rows) -> list:
    def ok(name, v):
        lo, hi = SIMULATION_RANGES[name]
        return lo <= v <= hi
    return [x for x in rows if ok("churn_reduction", x[1]) and ok("new_customers_month", x[2])
            and ok("price_increase", x[3])]


def projection(metrics: DataFrame, rows=None) -> DataFrame:
    """12 monthly rows per (tenant, valid scenario); tenants with
    ARPU 0 have no projection.

    ``rows`` are the user's what-if inputs (a handful of tuples). They are
    attached to each tenant row as a literal array and exploded, so the
    product tenants x scenarios x 12 months is generated, never joined.
    """
    rows = DEFAULT_SCENARIOS if rows is None else rows
    inputs = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(c)).alias("churn_reduction"),
                                F.lit(int(k)).cast("long").alias("new_customers_month"),
                                F.lit(float(pr)).alias("price_increase"))
                       for n, c, k, pr in _valid(rows)])
    base = (metrics.where(F.col("arpu") != 0)
                   .select("tenant_id", F.col("mrr").alias("base_mrr"), F.col("arpu").alias("base_arpu"),
                           F.coalesce("churn_rate", F.lit(SIMULATION_CHURN_FALLBACK_PCT)).alias("base_churn_rate")))
    p = (base.select("*", F.inline(inputs))
             .withColumn("r", F.col("base_churn_rate") / 100.0 * (1 - F.col("churn_reduction")))
             .withColumn("new_arpu", F.col("base_arpu") * (1 + F.col("price_increase")))
             .withColumn("s0", F.col("base_mrr") / F.col("base_arpu"))
             .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(SIMULATION_MONTHS)))))
    n = F.col("month")
    q = 1 - F.col("r")
    mrr = _mrr_at(n)
    prev = F.when(n == 1, F.col("base_mrr")).otherwise(_mrr_at(n - 1))
    subs = F.col("s0") * F.pow(q, n - 1) + F.col("new_customers_month") * _geo(q, n, F.col("r"))
    return p.select(
        "tenant_id", "scenario", "month", "churn_reduction", "new_customers_month", "price_increase",
        "base_mrr", "base_arpu", "base_churn_rate",
        (F.col("r") * 100).alias("new_churn_rate"), "new_arpu",
        mrr.alias("mrr"),
        (mrr - prev).alias("mrr_change"),
        F.when(prev != 0, (mrr - prev) / prev * 100.0).alias("mrr_change_pct"),
        F.bround(subs, 0).cast("long").alias("active_subscribers"),
        F.col("new_customers_month").alias("new_customers_added"),
        (F.col("r") * 100).alias("effective_churn_rate"),
    )


def summary(proj: DataFrame) -> DataFrame:
    """Final MRR and change % per (tenant, scenario)."""
    agg = proj.groupBy("tenant_id", "scenario", "base_mrr").agg(F.max_by("mrr", "month").alias("final_mrr"))
    return agg.select("tenant_id", "scenario", "base_mrr", "final_mrr",
                      F.when(F.col("base_mrr") != 0,
                             (F.col("final_mrr") - F.col("base_mrr")) / F.col("base_mrr") * 100.0)
                       .alias("mrr_change_pct"))


def totals(proj: DataFrame) -> DataFrame:
    """P5: the sheet's totals row (average MRR, summed change)."""
    return proj.groupBy("tenant_id", "scenario").agg(
        F.avg("mrr").alias("avg_mrr"), F.sum("mrr_change").alias("total_change"))
