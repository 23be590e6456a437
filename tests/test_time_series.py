"""Forecast (F*), what-if projection (P*), cohorts (B*)."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tests.conftest import months


def series_df(spark, ys_by_tenant):
    rows = [(t, [float(y) for y in ys], len(ys), 24000 + len(ys)) for t, ys in ys_by_tenant.items()]
    return spark.createDataFrame(rows, "tenant_id string, ys array<double>, n int, last_idx int")


def brute_trend(ys):
    best = None
    for ai, bi in itertools.product(range(1, 10), range(1, 10)):
        a, b = ai / 10.0, bi / 10.0
        level, trend, sse = ys[0], (ys[-1] - ys[0]) / (len(ys) - 1), 0.0
        for y in ys:
            sse += (y - (level + trend)) * (y - (level + trend))
            new_level = a * y + (1 - a) * (level + trend)
            trend = b * (new_level - level) + (1 - b) * trend
            level = new_level
        cand = (sse, a, b, level, trend)
        if best is None or cand < best:
            best = cand
    return best


def least_squares(run, starts):
    """Smallest squared error and final state over all starting values in the span of ``starts`` around the first one."""
    import numpy as np
    base, *units = starts
    e0, state0 = run(*base, data=True)
    effects = [run(*u, data=False) for u in units]
    k = np.linalg.lstsq(np.stack([e for e, _ in effects], 1), -e0, rcond=None)[0]
    e = e0 + sum(x * y for x, (y, _) in zip(k, effects))
    return float(e @ e), state0 + sum(x * y for x, (_, y) in zip(k, effects))


def holt(ys, a, b):
    import numpy as np

    def run(level, trend, data):
        e = []
        for y in ys:
            y = y if data else 0.0
            e.append(y - level - trend)
            new = a * y + (1 - a) * (level + trend)
            level, trend = new, b * (new - level) + (1 - b) * trend
        return np.array(e), np.array([level, trend])
    return least_squares(run, [(ys[0], (ys[-1] - ys[0]) / (len(ys) - 1)), (1, 0), (0, 1)])


def winters(ys, m, a, b, g):
    import numpy as np
    l0 = sum(ys[:m]) / m
    b0, s0 = (sum(ys[m:2 * m]) / m - l0) / m, [y - l0 for y in ys[:m]]

    def run(level, trend, season, data):
        e, season = [], list(season)
        for t, y in enumerate(ys):
            y, s = y if data else 0.0, season[t % m]
            e.append(y - level - trend - s)
            new = a * (y - s) + (1 - a) * (level + trend)
            season[t % m] = g * (y - level - trend) + (1 - g) * s
            level, trend = new, b * (new - level) + (1 - b) * trend
        return np.array(e), np.array([level, trend, *season])
    return least_squares(run, [(l0, b0, s0), (1, 0, [0] * m), (0, 1, [0] * m), (0, 0, s0)])


SERIES = {"a": [100, 120, 150, 160, 200], "b": [5, 3, 8, 1, 9, 4, 7], "c": [10, 14, 9, 15, 11, 16, 10, 17, 12, 18],
          "d": [3, 9, 4, 12, 8, 20, 11, 5, 30, 12, 14, 9, 2, 40, 13], "line": [10, 20, 30, 40, 50, 60]}


def test_trend_fit_is_as_good_as_a_fine_grid(spark):
    from recurra.operators import forecast as FC
    got = {r["tenant_id"]: r for r in FC.fit_trend(series_df(spark, SERIES)).collect()}
    for t, ys in SERIES.items():
        r = got[t]
        sse, (level, trend) = holt(ys, r["alpha"], r["beta"])
        assert r["sse"] == pytest.approx(sse, abs=1e-6) and r["level"] == pytest.approx(level, abs=1e-6) and r["trend"] == pytest.approx(trend, abs=1e-6)
        fine = min(holt(ys, i / 50, j / 50)[0] for i in range(1, 50) for j in range(1, 50))
        assert r["sse"] <= 1.01 * fine + 1e-9 and r["sse"] <= brute_trend(ys)[0] + 1e-9


def test_seasonal_fit_is_as_good_as_a_fine_grid(spark):
    from recurra.operators import forecast as FC
    got = {r["tenant_id"]: r for r in FC.fit_seasonal(series_df(spark, SERIES)).collect()}
    for t in ("c", "d"):
        ys, r = SERIES[t], got[t]
        m = min(12, max(2, len(ys) // 2))
        sse, (level, trend, *season) = winters(ys, m, r["alpha"], r["beta"], r["gamma"])
        assert r["seasonal_periods"] == m and r["sse"] == pytest.approx(sse, abs=1e-5)
        assert [r["level"], r["trend"], *r["season"]] == pytest.approx([level, trend, *season], abs=1e-5)
        edges = [0.0001, *[i / 12 for i in range(1, 12)], 0.9999]
        assert r["sse"] <= 1.01 * min(winters(ys, m, a, b, g)[0] for a in edges for b in edges for g in edges) + 1e-9


def growing(n_months):
    """One new customer per month (the reference's forecast frames)."""
    return [(f"C{i}", d, 100 + 10 * i, "active") for i, d in enumerate(months(2024, 1, n_months))]


@pytest.mark.parametrize("n,status,n_scen", [(2, "insufficient", 0), (3, "realistic_only", 1),
                                             (5, "realistic_only", 1), (6, "full", 3), (12, "full", 3)])
def test_forecast_gates(spark, subs_of, n, status, n_scen):
    from recurra.operators import forecast as FC
    from recurra.operators import metrics as MX
    r = MX.Rollup(subs_of(growing(n)))
    series = FC.monthly_series(r.base)
    assert FC.forecast_status(series).first()["status"] == status
    sc = FC.scenarios(FC.projections(series), churn=MX.metrics_last(r)).collect()
    assert len(sc) == 12 * n_scen
    assert all(x["value"] >= 0 for x in sc)
    if n_scen:
        assert sorted({x["horizon"] for x in sc}) == list(range(1, 13))
        assert sc and all(x["period"] > "2024-" + f"{n:02d}" for x in sc)


def test_scenario_ordering_and_churn_inputs(spark, subs_of):
    from recurra.operators import forecast as FC
    from recurra.operators import metrics as MX
    rows = [(f"C{c}", d, 100 + c + 7 * i, "active") for c in range(8) for i, d in enumerate(months(2024, 1, 12))]
    r = MX.Rollup(subs_of(rows))
    proj = FC.projections(FC.monthly_series(r.base))
    for kw in ({"churn_fraction": 0.1}, {"churn": MX.metrics_last(r)}, {}):
        sc = FC.scenarios(proj, **kw).collect()
        by = {(x["horizon"], x["scenario"]): x for x in sc}
        for h in range(1, 13):
            assert by[(h, "optimistic")]["value"] >= by[(h, "realistic")]["value"] >= by[(h, "pessimistic")]["value"]
        used = {x["churn_rate_used"] for x in sc}
        assert used == ({0.1} if kw.get("churn_fraction") else {0.0} if "churn" in kw else {0.05})


def test_degenerate_series(spark, subs_of):
    from recurra.operators import forecast as FC
    from recurra.operators import metrics as MX
    rows = [(f"C{c}", d, 100, "active") for c in range(10) for d in months(2024, 1, 12)]
    series = FC.monthly_series(MX.Rollup(subs_of(rows)).base)
    assert FC.forecast_status(series).first()["status"] == "degenerate"
    assert FC.projections(series).count() == 0


def loop_projection(base_mrr, arpu, churn_pct, reduction, new, price):
    r = churn_pct / 100 * (1 - reduction)
    new_arpu = arpu * (1 + price)
    existing, new_mrr, cum_new, prev, out = base_mrr / arpu, 0.0, 0.0, base_mrr, []
    for _ in range(12):
        mrr_existing = existing * new_arpu
        cum_new += new
        new_mrr += new * new_arpu
        total = max(0.0, mrr_existing + new_mrr)
        out.append((total, total - prev, round(existing + cum_new)))
        prev = total
        existing *= (1 - r)
        cum_new *= (1 - r)
        new_mrr *= (1 - r)
    return out


def test_projection_equals_month_loop(spark):
    from recurra.operators import scenario as SC
    metrics = spark.createDataFrame([("t", 1000.0, 50.0, 10.0), ("z", 0.0, 0.0, None)],
                                    "tenant_id string, mrr double, arpu double, churn_rate double")
    rows = [("a", 0.0, 0, 0.0), ("b", 0.5, 3, 0.1), ("c", 1.0, 0, 0.0), ("d", 0.2, 7, -0.3), ("bad", 2.0, 0, 0.0)]
    got = {(r["scenario"], r["month"]): r for r in SC.projection(metrics, rows).collect()}
    assert {k[0] for k in got} == {"a", "b", "c", "d"}  # out-of-range set and zero-ARPU tenant excluded
    for name, red, new, price in rows[:4]:
        exp = loop_projection(1000.0, 50.0, 10.0, red, new, price)
        for m in range(1, 13):
            g = got[(name, m)]
            assert g["mrr"] == pytest.approx(exp[m - 1][0])
            assert g["mrr_change"] == pytest.approx(exp[m - 1][1], abs=1e-6)
            assert g["active_subscribers"] == exp[m - 1][2]
    assert all(got[("c", m)]["mrr"] == pytest.approx(1000.0) for m in range(1, 13))  # full churn reduction: flat
    assert all(got[("a", m + 1)]["mrr"] < got[("a", m)]["mrr"] for m in range(1, 12))  # decay
    rej = {r["scenario"]: r["rejected_fields"] for r in SC.rejects_by_tenant(metrics, rows).collect()
           if r["tenant_id"] == "t"}
    assert rej == {"bad": "churn_reduction"}
    summ = {r["scenario"]: r for r in SC.summary(SC.projection(metrics, rows)).collect()}
    assert summ["c"]["mrr_change_pct"] == pytest.approx(0.0, abs=1e-9)


def test_cohort_gate_and_grid(spark, subs_of):
    from recurra.operators import cohort as CO
    from recurra.operators import metrics as MX
    two = [("A", "2024-11-01", 100, "active"), ("B", "2024-12-01", 100, "active")]
    assert CO.cohort_grid(MX.Rollup(subs_of(two)).hist).count() == 0
    rows = [("A", "2024-10-01", 100, "active"), ("A", "2024-11-01", 0, "active"), ("A", "2024-12-01", 100, "active"),
            ("B", "2024-10-01", 100, "active"),
            ("C", "2024-11-01", 100, "active"), ("C", "2024-12-01", 100, "churned"),
            ("D", "2024-12-01", 100, "active")]
    grid = {(r["cohort"], r["month_n"]): r for r in CO.cohort_grid(MX.Rollup(subs_of(rows)).hist).collect()}
    assert grid[("2024-10", 0)]["size"] == 2 and grid[("2024-10", 0)]["pct"] == 100.0
    assert grid[("2024-10", 1)]["pct"] == 50.0          # zero-amount active row counts as retained
    assert grid[("2024-11", 1)]["pct"] == 0.0           # churned row is not retention
    assert grid[("2024-12", 2)]["pct"] == 0.0           # dense grid beyond the data: 0.0
    assert grid[("2024-12", 2)]["is_observed"] is False
    assert max(k[1] for k in grid) == 2


def test_cohort_keeps_latest_twelve(spark, subs_of):
    from recurra.operators import cohort as CO
    from recurra.operators import metrics as MX
    rows = [(f"C{i}", d, 10, "active") for i, d in enumerate(months(2023, 1, 12) + months(2024, 1, 6))]
    sel = CO.cohort_selection(MX.Rollup(subs_of(rows)).hist).collect()
    assert len(sel) == 12 and min(r["cohort"] for r in sel) == "2023-07"
