"""Report tables (S10, S11, S15, S16, S19, X1): long-form rows, not files.

Rendering (workbook/PDF drawing, charts) is out of scope; these are the
table contents, computed per tenant from the metric bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: summary rows (block, order, metric key, label, kind) -----
SUMMARY_ROWS = [
    (1, 1, "mrr", "MRR", "currency"),
    (1, 2, "arr", "ARR", "currency"),
    (1, 3, "arpu", "ARPU", "currency"),
    (1, 4, "total_revenue", "Total Revenue", "currency"),
    (2, 1, "new_mrr", "New MRR", "currency"),
    (2, 2, "reactivation_mrr", "Reactivation MRR", "currency"),
    (2, 3, "growth_rate", "Growth Rate", "pct"),
    (2, 4, "new_subscribers", "New Subscribers", "int"),
    (2, 5, "reactivated_subscribers", "Reactivated Subscribers", "int"),
    (3, 1, "churn_rate", "Churn Rate", "pct"),
    (3, 2, "voluntary_churn_rate", "Voluntary Churn", "pct"),
    (3, 3, "involuntary_churn_rate", "Involuntary Churn", "pct"),
    (3, 4, "revenue_churn", "Revenue Churn", "currency"),
    (3, 5, "nrr", "NRR", "pct"),
    (4, 1, "ltv", "LTV", "currency"),
    (4, 2, "active_subscribers", "Active Subscribers", "int"),
    (4, 3, "lost_subscribers", "Lost Subscribers", "int"),
    (4, 4, "existing_subscribers", "Existing Subscribers", "int"),
]
# --- fixed values: the note shown beside each summary row -------------------
SUMMARY_NOTES = {
    "mrr": "Σ amount (active rows, last_month); multi-row → sum per customer first",
    "arr": "MRR × 12",
    "arpu": "MRR ÷ unique active customers (last_month). 0 if count==0",
    "total_revenue": "Σ all positive amounts across all time and all statuses",
    "new_mrr": "Active rows in last_month WHERE customer is 'new' (first-ever appearance)",
    "reactivation_mrr": "Active rows WHERE customer absent 2–9mo then reappears. NOT in New MRR.",
    "growth_rate": "((MRR_last − MRR_prev) ÷ MRR_prev) × 100. N/A if prev==0 or gap.",
    "new_subscribers": "Count of unique new customer_ids (first appearance ever) in last_month",
    "reactivated_subscribers": "Count absent 2–9mo then reappearing. Excluded if max(amount) > 6× ARPU.",
    "churn_rate": "(lost_subs ÷ active_prev_month) × 100. N/A if prev==0 or gap.",
    "voluntary_churn_rate": "Customers who cancelled intentionally (status='churned'). N/A if prev==0 or gap.",
    "involuntary_churn_rate": "Customers lost due to payment failures (status='past_due'). Recoverable via dunning.",
    "revenue_churn": "Scenarios A/B/C/D — see spec Section 8. Refund not double-counted.",
    "nrr": "CLAMP(((MRR_last − rev_churn + exp_mrr) ÷ MRR_prev) × 100, 0, 999)",
    "ltv": "ARPU ÷ (churn_rate / 100). Cap = ARPU×36 if churn==0. NOT for unit economics.",
    "active_subscribers": "Unique customer_ids with status=='active' in last_month",
    "lost_subscribers": "Active in prev_month, absent from active rows in last_month",
    "existing_subscribers": "Active in BOTH prev_month AND last_month",
}
# --- fixed values: detail rows (metric key, kind, formula shown) -------------
DETAIL_ROWS = [
    ("mrr", "currency", "Calculated from raw data"),
    ("arr", "currency", "=B3*12"),
    ("arpu", "currency", "=IF(B16=0,0,B3/B16)"),
    ("total_revenue", "currency", "Calculated from raw data"),
    ("new_mrr", "currency", "Calculated from raw data"),
    ("reactivation_mrr", "currency", "Calculated from raw data"),
    ("growth_rate", "pct", '=IF(B19=0,"N/A",(B3-B19)/B19*100)'),
    ("new_subscribers", "int", "Calculated from raw data"),
    ("reactivated_subscribers", "int", "Calculated from raw data"),
    ("churn_rate", "pct", '=IF(B20=0,"N/A",B17/B20*100)'),
    ("revenue_churn", "currency", "Calculated from raw data"),
    ("nrr", "pct", "=MAX(0,MIN(999,(B3-B13+B21)/B19*100))"),
    ("ltv", "currency", "=IF(B12=0,B5*36,B5/(B12/100))"),
    ("active_subscribers", "int", "Calculated from raw data"),
    ("lost_subscribers", "int", "=B20-B18"),
    ("existing_subscribers", "int", "Calculated from raw data"),
    ("mrr_prev_month", "currency", "MRR of previous month"),
    ("active_subscribers_prev_month", "int", "Active subscribers in previous month"),
    ("expansion_mrr", "currency", "MRR increase from existing customers"),
]
# --- fixed values: what each data-quality flag means -------------------------
FLAG_MEANINGS = {
    "prev_month_status": "'ok' = Previous month data available. 'gap' = Missing calendar month. "
                         "'missing' = No data before last month. "
                         "Affects: Growth Rate, Churn Rate, NRR, Lost Subscribers (shown as N/A when not 'ok').",
    "last_month_is_fallback": "True = Last month has fewer than 5 active customers (data quality warning shown). "
                              "False = Last month meets minimum threshold for reliable metrics.",
    "last_month_used": "The calendar month (YYYY-MM) used as 'last month' for all metric calculations. "
                       "This is the most recent month with sufficient data.",
}
BLOCK_NAMES = {1: "revenue", 2: "growth", 3: "retention", 4: "health"}
# Metrics whose status is N/A when not computable.
NA_WHEN_NULL = {"growth_rate", "churn_rate", "voluntary_churn_rate", "lost_subscribers"}
# --- fixed values: block visibility by plan (projection: top plan only) ----
PLAN_BLOCKS = {"free": [1, 2], "starter": [1, 2, 3, 4], "pro": [1, 2, 3, 4, 5]}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "RUB": "₽"}


def fmt_currency(value: Column, currency: Column | None = None) -> Column:
    """Symbol + thousands-separated 2 decimals; NULL -> 'N/A'."""
    cur = F.upper(F.coalesce(currency, F.lit("USD"))) if currency is not None else F.lit("USD")
    sym_map = F.create_map(*[x for k, v in CURRENCY_SYMBOLS.items() for x in (F.lit(k), F.lit(v))])
    sym = F.coalesce(F.element_at(sym_map, cur), F.concat(cur, F.lit(" ")))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(
        F.concat(sign, sym, F.format_number(F.abs(value), 2)))


def fmt_pct(value: Column, decimals: int = 2) -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_string(f"%.{decimals}f%%", value))


def fmt_int(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_number(value.cast("long"), 0))


def _value_double(key: str) -> Column:
    return F.col(key).cast("double")


def _shown(key: str, kind: str, currency: Column | None) -> Column:
    if kind == "currency":
        return fmt_currency(_value_double(key), currency)
    return fmt_pct(_value_double(key)) if kind == "pct" else fmt_int(F.col(key))


def report_summary(metrics: DataFrame, currency: DataFrame | None = None) -> DataFrame:
    """18 rows per tenant (unpivot of the bundle), formatted value, note and
    status (✓ / N/A / ⚠ >200% / 🔧 for involuntary churn above 0)."""
    m = metrics if currency is None else metrics.join(currency, "tenant_id", "left")
    cur = F.col("currency_label") if currency is not None else None
    rows = []
    for block, order, key, label, kind in SUMMARY_ROWS:
        v = _value_double(key)
        shown = _shown(key, kind, cur)
        if key in NA_WHEN_NULL:
            status = F.when(v.isNull(), F.lit("N/A")).otherwise(F.lit("✓"))
        elif key == "nrr":
            status = F.when(F.coalesce(v, F.lit(0.0)) > 200, F.lit("⚠ >200%")).otherwise(F.lit("✓"))
        elif key == "involuntary_churn_rate":
            status = F.when(F.coalesce(v, F.lit(0.0)) > 0, F.lit("🔧")).otherwise(F.lit("✓"))
        else:
            status = F.lit("✓")
        rows.append(F.struct(F.lit(block).alias("block"), F.lit(BLOCK_NAMES[block]).alias("block_name"),
                             F.lit(order).alias("row_order"), F.lit(key).alias("metric"),
                             F.lit(label).alias("label"), v.alias("value"),
                             shown.alias("value_text"), F.lit(SUMMARY_NOTES[key]).alias("note"),
                             status.alias("status")))
    return m.select("tenant_id", F.inline(F.array(*rows)))


def report_detail(metrics: DataFrame, currency: DataFrame | None = None) -> DataFrame:
    """The 19 detail rows per tenant: raw value, formatted value and the formula shown."""
    m = metrics if currency is None else metrics.join(currency, "tenant_id", "left")
    cur = F.col("currency_label") if currency is not None else None
    rows = [F.struct(F.lit(i + 1).alias("row_order"), F.lit(key).alias("metric"), _value_double(key).alias("raw_value"),
                     _shown(key, kind, cur).alias("formatted_value"), F.lit(formula).alias("formula"))
            for i, (key, kind, formula) in enumerate(DETAIL_ROWS)]
    return m.select("tenant_id", F.inline(F.array(*rows)))


def metric_reconciliation(metrics: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Recompute each metric from its neighbours as the detail sheet's
    formulas do and report the gap. ARPU (by active-status subscribers) and
    NRR (with expansion) legitimately differ from the engine's definitions."""
    m = metrics
    prev = F.col("mrr_prev_month")
    checks = [
        ("arr", F.col("arr"), F.col("mrr") * 12),
        ("arpu", F.col("arpu"), F.when(F.col("active_subscribers") > 0, F.col("mrr") / F.col("active_subscribers"))),
        ("growth_rate", F.col("growth_rate"),
         F.when(prev.isNotNull() & (prev != 0), (F.col("mrr") - prev) / prev * 100)),
        ("churn_rate", F.col("churn_rate"),
         F.when(F.col("active_subscribers_prev_month") > 0,
                F.col("lost_subscribers") / F.col("active_subscribers_prev_month") * 100)),
        ("nrr", F.col("nrr"),
         F.when(prev.isNotNull() & (prev != 0),
                F.least(F.greatest((F.col("mrr") - F.col("revenue_churn") + F.coalesce(F.col("expansion_mrr"), F.lit(0.0)))
                                   / prev * 100, F.lit(0.0)), F.lit(999.0)))),
        ("ltv", F.col("ltv"),
         F.when(F.col("churn_rate").isNull() | (F.col("churn_rate") == 0), F.col("arpu") * 36)
          .otherwise(F.col("arpu") / (F.col("churn_rate") / 100))),
        ("lost_subscribers", F.col("lost_subscribers").cast("double"),
         (F.col("active_subscribers_prev_month") - F.col("existing_subscribers")).cast("double")),
    ]
    rows = [F.struct(F.lit(n).alias("metric"), a.cast("double").alias("reported"), b.cast("double").alias("recomputed"))
            for n, a, b in checks]
    out = m.select("tenant_id", F.inline(F.array(*rows)))
    diff = F.abs(F.col("reported") - F.col("recomputed"))
    return out.withColumn("abs_diff", diff).withColumn(
        "consistent", F.coalesce(diff <= eps, F.col("reported").isNull() & F.col("recomputed").isNull()))


def report_quality(metrics: DataFrame) -> DataFrame:
    """The three data-quality flags as rows, with what they mean."""
    meaning = lambda flag: F.lit(FLAG_MEANINGS[flag]).alias("meaning")
    rows = F.array(
        F.struct(F.lit(1).alias("row_order"), F.lit("prev_month_status").alias("flag"),
                 F.col("prev_month_status").alias("value"), meaning("prev_month_status")),
        F.struct(F.lit(2).alias("row_order"), F.lit("last_month_is_fallback").alias("flag"),
                 F.when(F.col("last_month_is_fallback"), F.lit("True")).otherwise(F.lit("False")).alias("value"),
                 meaning("last_month_is_fallback")),
        F.struct(F.lit(3).alias("row_order"), F.lit("last_month_used").alias("flag"),
                 F.coalesce(F.col("last_month"), F.lit("N/A")).alias("value"), meaning("last_month_used")),
    )
    return metrics.select("tenant_id", F.inline(rows))


def quality_messages(metrics: DataFrame, keys: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Warning messages raised by the flags (one row per message)."""
    msgs = F.array(
        F.when(F.col("prev_month_status") == "gap", F.struct(
            F.lit("prev_month_gap").alias("code"), F.lit("warning").alias("level"),
            F.concat(F.lit("The month before "), F.coalesce(F.col("last_month"), F.lit("N/A")),
                     F.lit(" has no paying rows; comparisons are not available.")).alias("message"))),
        F.when(F.col("prev_month_status") == "missing", F.struct(
            F.lit("prev_month_missing").alias("code"), F.lit("info").alias("level"),
            F.lit("There is no data before the last month; comparisons are not available.").alias("message"))),
        F.when(F.col("last_month_is_fallback"), F.struct(
            F.lit("last_month_fallback").alias("code"), F.lit("warning").alias("level"),
            F.concat(F.lit("Fewer than 5 paying customers in "), F.coalesce(F.col("last_month"), F.lit("N/A")),
                     F.lit("; metrics may be unreliable.")).alias("message"))),
        F.when(F.col("nrr_warning"), F.struct(
            F.lit("nrr_above_200").alias("code"), F.lit("warning").alias("level"),
            F.lit("NRR exceeds 200% - likely caused by limited prior-month data.").alias("message"))),
    )
    return (metrics.select(*keys, F.explode(F.filter(msgs, lambda x: x.isNotNull())).alias("m"))
                   .select(*keys, "m.code", "m.level", "m.message"))


def report_by_plan(summary: DataFrame) -> DataFrame:
    """The summary rows each plan may see (free: blocks 1-2; paid: all)."""
    vis = F.create_map(*[x for p, blocks in PLAN_BLOCKS.items()
                         for x in (F.lit(p), F.array(*[F.lit(b) for b in blocks]))])
    plans = F.array(*[F.lit(p) for p in PLAN_BLOCKS])
    return (summary.withColumn("plan", F.explode(plans))
                   .where(F.array_contains(F.element_at(vis, F.col("plan")), F.col("block"))))
