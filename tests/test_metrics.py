"""Metric semantics on small hand-built frames (modelled on the reference's
inline test cases)."""

from __future__ import annotations

import pytest

from tests.conftest import months


def steady(cust, first, last, amount=100, status="active"):
    return [(cust, d, amount, status) for d in months(2024, first, last)]


def test_basic(metrics_of):
    rows = [r for c in range(10) for r in steady(f"C{c}", 1, 12)]
    m = metrics_of(rows)
    assert m["mrr"] == 1000.0
    assert m["arr"] == 12000.0
    assert m["arpu"] == 100.0
    assert m["total_revenue"] == 12000.0
    assert m["lost_subscribers"] == 0
    assert m["existing_subscribers"] == 10
    assert m["last_month"] == "2024-12"
    assert m["prev_month_status"] == "ok"
    assert m["last_month_is_fallback"] is False
    assert m["growth_rate"] == 0.0
    assert m["nrr"] == 100.0
    assert m["ltv"] == 3600.0


def test_multi_row_customer_sums_first(metrics_of):
    rows = steady("A", 11, 12, 100) + [("A", "2024-12-20", 250, "active")] + steady("B", 11, 12)
    m = metrics_of(rows)
    assert m["mrr"] == 450.0
    assert m["arpu"] == 225.0


def test_zero_amount_excluded_from_mrr(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 11, 11)]
    rows += [(f"C{c}", "2024-12-10", 100, "active") for c in range(3)]
    rows += [(f"C{c}", "2024-12-10", 0, "active") for c in range(3, 5)]
    m = metrics_of(rows)
    assert m["mrr"] == 300.0
    assert m["last_month_is_fallback"] is True
    assert m["active_subscribers"] == 5


def test_negative_amount_kept_as_refund(metrics_of):
    rows = [("A", "2024-11-10", 100, "active"), ("B", "2024-11-10", 100, "active"),
            ("A", "2024-12-10", 300, "active"), ("B", "2024-12-11", -50, "active")]
    m = metrics_of(rows)
    assert m["mrr"] == 300.0
    assert m["active_subscribers"] == 2
    assert m["total_revenue"] == 500.0
    # Scenario B: refund of a customer who is not churned (has an active row).
    assert m["revenue_churn"] == 50.0


def test_new_customers(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 11, 12)] + [("NEW", "2024-12-05", 200, "active")]
    m = metrics_of(rows)
    assert m["new_mrr"] == 200.0
    assert m["new_subscribers"] == 1
    assert m["existing_subscribers"] == 5


def test_new_customer_any_status_counts(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 11, 12)] + [("T", "2024-12-05", 0, "trial")]
    m = metrics_of(rows)
    assert m["new_subscribers"] == 1
    assert m["new_mrr"] == 0.0


def test_reactivation(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 1, 12)]
    rows += steady("R", 1, 8) + steady("R", 12, 12)
    m = metrics_of(rows)
    assert m["reactivation_mrr"] == 100.0
    assert m["reactivated_subscribers"] == 1
    assert m["new_mrr"] == 0.0


@pytest.mark.parametrize("back_months", [[11], [2]])
def test_reactivation_window_limits(metrics_of, back_months):
    # one month absent (Nov only) or ten months absent (Feb-Nov): not reactivated
    rows = [r for c in range(5) for r in steady(f"C{c}", 1, 12)]
    if back_months == [11]:
        rows += steady("R", 1, 10) + steady("R", 12, 12)
    else:
        rows += steady("R", 1, 1) + steady("R", 12, 12)
    m = metrics_of(rows)
    assert m["reactivated_subscribers"] == 0
    assert m["reactivation_mrr"] == 0.0


def test_nine_months_absent_is_reactivated(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 1, 12)]
    rows += steady("R", 1, 2) + steady("R", 12, 12)
    m = metrics_of(rows)
    assert m["reactivated_subscribers"] == 1


def test_annual_plan_not_reactivated(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 1, 12)]
    rows += [("ANN", "2024-03-01", 1200, "active"), ("ANN", "2024-12-01", 100, "active")]
    m = metrics_of(rows)
    assert m["reactivated_subscribers"] == 0


def test_gap_month(metrics_of):
    rows = [(f"C{c}", d, 45, "active") for c in range(15) for d in ["2024-01-05", "2024-02-05", "2024-04-05"]]
    m = metrics_of(rows)
    assert m["prev_month_status"] == "gap"
    assert m["growth_rate"] is None
    assert m["churn_rate"] is None
    assert m["nrr"] is None
    assert m["lost_subscribers"] is None
    assert m["existing_subscribers"] == 0
    assert m["revenue_churn"] == 0.0


def test_revenue_churn_scenario_c(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 11, 12)]
    rows += [("X", "2024-11-05", 100, "active"), ("X", "2024-12-05", -100, "churned")]
    m = metrics_of(rows)
    assert m["revenue_churn"] == 100.0


def test_revenue_churn_scenario_d(metrics_of):
    rows = [r for c in range(5) for r in steady(f"C{c}", 10, 12)]
    rows += [("X", "2024-10-05", 100, "active"), ("X", "2024-11-05", -30, "active"),
             ("X", "2024-11-06", 100, "active"), ("X", "2024-12-05", 0, "churned")]
    m = metrics_of(rows)
    assert m["revenue_churn"] == 100.0


def test_no_prev_month(metrics_of):
    rows = [(f"C{c}", "2024-12-01", 100, "active") for c in range(5)]
    m = metrics_of(rows)
    assert m["prev_month_status"] == "missing"
    for k in ("growth_rate", "churn_rate", "voluntary_churn_rate", "involuntary_churn_rate", "nrr",
              "lost_subscribers", "mrr_prev_month", "expansion_mrr"):
        assert m[k] is None
    assert m["ltv"] == m["arpu"] * 36
    assert m["new_subscribers"] == 5


def test_nrr_clamped_and_warned(metrics_of):
    rows = [("A", "2024-11-01", 100, "active"), ("A", "2024-12-01", 1300, "active")]
    m = metrics_of(rows)
    assert m["nrr"] == 999.0
    assert m["nrr_warning"] is True
    assert m["expansion_mrr"] == 1200.0


def test_voluntary_involuntary_split(metrics_of):
    rows = [(f"C{c}", "2024-11-01", 100, "active") for c in range(11)]
    rows += [(f"C{c}", "2024-12-01", 100, "active") for c in range(5)]
    rows += [(f"C{c}", "2024-12-02", 0, "churned") for c in range(5, 9)]
    rows += [("C8", "2024-12-03", 0, "past_due")]
    rows += [(f"C{c}", "2024-12-02", 0, "past_due") for c in range(9, 11)]
    m = metrics_of(rows)
    assert m["churn_rate"] == pytest.approx(6 / 11 * 100)
    assert m["voluntary_churn_rate"] == pytest.approx(36.3636, abs=1e-3)
    assert m["involuntary_churn_rate"] == pytest.approx(18.1818, abs=1e-3)


def test_status_spellings_normalised(metrics_of):
    rows = [("A", "2024-12-01", 10, "Active"), ("B", "2024-12-01", 10, " ACTIVE "),
            ("C", "2024-12-01", 10, "Cancelled"), ("D", "2024-12-01", 10, "Payment Failed")]
    m = metrics_of(rows)
    assert m["mrr"] == 20.0


def test_nan_and_bad_values(metrics_of):
    rows = [("A", "2024-12-01", "NaN", "active"), ("B", "2024-12-01", "$5", "active"),
            ("C", "2024-12-01", "49d", "active"), ("D", "not a date", 70, "active"),
            ("E", "2024-12-01", "10.5", "active")]
    m = metrics_of(rows)
    assert m["mrr"] == 10.5
    # The undated row still counts in total revenue.
    assert m["total_revenue"] == 80.5


def test_no_paying_rows(metrics_of):
    rows = [(f"C{c}", "2024-12-01", 0, "active") for c in range(3)]
    m = metrics_of(rows)
    assert m["mrr"] == 0.0 and m["arpu"] == 0.0 and m["ltv"] == 0.0
    assert m["last_month"] is None
    assert m["prev_month_status"] == "missing"
    assert m["last_month_is_fallback"] is True
    assert m["revenue_churn"] == 0.0


def test_invariants_on_driver_data(spark):
    """MRR >= new + reactivation; existing + lost = prev active."""
    from recurra.plans import catalog
    m = catalog.QUERIES["all_metrics_by_month"](spark, "/root/testdata/sf0.001").collect()
    assert m
    for r in m:
        assert r["mrr"] + 1e-6 >= r["new_mrr"] + r["reactivation_mrr"]
        if r["prev_month_status"] == "ok":
            assert r["existing_subscribers"] + r["lost_subscribers"] == r["active_subscribers_prev_month"]


def test_metrics_invariant_under_repartitioning(spark, subs_of):
    from recurra.operators import metrics as MX
    rows = [r for c in range(7) for r in steady(f"C{c}", 1, 12, 10 + c)] + steady("R", 1, 3) + steady("R", 12, 12)
    subs = subs_of(rows)
    a = sorted(MX.metrics_last(MX.Rollup(subs)).collect())
    b = sorted(MX.metrics_last(MX.Rollup(subs.repartition(7).orderBy("amount"))).collect())
    assert a == b


def test_shuffles_grow_with_the_stored_input(spark, monkeypatch):
    from recurra import session
    from recurra.plans import catalog
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        monkeypatch.setattr(session, "SHARE_BYTES", 10_000)
        n = -(-sum(x for _, x, _ in catalog.table_files(spark, "/root/testdata/sf0.001", "lineitem", "orders", "customer")[1:]) // 10_000)
        plan = catalog.subscriptions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert n > int(before[keys[0]]) and f", {n})" in plan and f", {before[keys[0]]})" not in plan
        assert session.fit_shuffles(spark, 10) == n  # a larger number stays
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shuffles_grow_with_rows_that_compress_well(spark, monkeypatch, tmp_path):
    from recurra import session
    from recurra.plans import catalog
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        monkeypatch.setattr(session, "SHARE_BYTES", 10_000)
        for t in ("lineitem", "orders", "customer"):
            spark.range(30_000).selectExpr("1 AS k").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        catalog._input_key(spark, str(tmp_path))  # the tables hold few bytes
        assert int(spark.conf.get(keys[0])) >= 30_000 * 18 // 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
