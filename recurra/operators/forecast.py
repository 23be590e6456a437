"""MRR forecast.

The series is a tenant's monthly MRR over the months that have paying rows
(bounded by the number of months, never by rows), held as one
``ARRAY<DOUBLE>`` per tenant. Models are additive Holt (trend) and additive
Holt-Winters (trend + season, period ``min(12, max(2, n // 2))``). The smoothing
parameters are fitted by a grid and finer grids around its best cell, smallest
squared one-step error first (ties: smallest parameters). For given parameters
the errors are linear in the starting values, so the best starting level, trend
and size of the season come in closed form from sums taken in the same run. A
tenant's fit is one row's work, done for all points of a grid at once with numpy
in the task (folds of higher-order functions are interpreted and took several
times as long). The reference's numerical optimiser itself is not reproduced.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.functions import columns as C
from recurra.functions.constants import (
    FORECAST_CHURN_FALLBACK, FORECAST_FULL_MONTHS, FORECAST_HORIZON, FORECAST_MIN_MONTHS,
    SCENARIO_FACTORS, SEASONAL_PERIODS_MAX)

TREND_GRID = list(range(1, 10))          # alpha, beta in 0.1 .. 0.9
SEASONAL_GRID = [1, 3, 5, 7, 9]          # alpha, beta, gamma in 0.1, 0.3, .. 0.9
# Steps of the finer grids around the best cell, and how near to 0 and 1 a parameter may come.
TREND_STEPS = [0.04, 0.016, 0.0064, 0.00256]
SEASONAL_STEPS = [0.1, 0.05, 0.025, 0.0125, 0.00625]
EDGE = 0.0001


def monthly_series(base: DataFrame) -> DataFrame:
    """A5 as one sorted array per tenant (months with paying rows only)."""
    months = base.where(F.col("period_idx").isNotNull() & (F.col("n_paying") > 0))
    pts = months.groupBy("tenant_id").agg(
        F.array_sort(F.collect_list(F.struct("period_idx", F.col("mrr").cast("double").alias("v")))).alias("pts"))
    return pts.select(
        "tenant_id",
        F.transform("pts", lambda p: p["v"]).alias("ys"),
        F.size("pts").alias("n"),
        F.element_at("pts", -1)["period_idx"].alias("last_idx"))


def _refined(run, names: int, first: list[float], steps: list[float], spread: list[int]):
    """The best of a grid and then of finer grids, each around the best cell of the last: (sse, parameters, state).

    ``run`` takes one array per parameter, all grid points at once, and gives their errors and states. Ties go to the
    smallest parameters.
    """
    best = None
    for k, values in enumerate([first, *[[i * step for i in spread] for step in steps]]):
        points = np.array(list(product(values, repeat=names))).T
        if k:
            points = np.maximum(np.minimum(np.array(best[1])[:, None] + points, 1 - EDGE), EDGE)
        sse, state = run(*points)
        at = np.lexsort((*points[::-1], sse))[0]
        best = float(sse[at]), [float(p[at]) for p in points], [x[at] for x in state]
    return best


def _trend_run(ys: list[float]):
    """One run over the series for all (alpha, beta): errors are linear in the starting values, so beside the run from
    the usual start two runs of a unit level and a unit trend tell what a change of them would do."""
    def run(alpha, beta):
        zero = np.zeros(len(alpha))
        level, trend = [zero + ys[0], zero + 1, zero], [zero + (ys[-1] - ys[0]) / (len(ys) - 1), zero, zero + 1]
        cc = ca = cd = aa = ad = dd = zero
        for y in ys:
            c, a, d = y - (level[0] + trend[0]), -(level[1] + trend[1]), -(level[2] + trend[2])
            cc, ca, cd, aa, ad, dd = cc + c * c, ca + c * a, cd + c * d, aa + a * a, ad + a * d, dd + d * d
            for k, x in enumerate((y, 0.0, 0.0)):
                up = alpha * x + (1 - alpha) * (level[k] + trend[k])
                level[k], trend[k] = up, beta * (up - level[k]) + (1 - beta) * trend[k]
        det = aa * dd - ad * ad
        fine, safe = det > 1e-9 * aa * dd, np.where(det == 0, 1, det)
        dl, db = (np.where(fine, x / safe, 0.0) for x in (ad * cd - dd * ca, ad * ca - aa * cd))
        sse = np.maximum(cc + dl * ca + db * cd, 0.0)
        return sse, [level[0] + dl * level[1] + db * level[2], trend[0] + dl * trend[1] + db * trend[2]]
    return run


def _seasonal_run(ys: list[float], m: int):
    """As the trend's, with the season. Four runs: from the usual start, of a unit level, of a unit trend, and of the
    first season's shape, whose size is fitted as the level and trend are."""
    def total(values):
        out = 0.0
        for v in values:
            out += v
        return out
    l0 = total(ys[:m]) / m
    b0, s0 = (total(ys[m:2 * m]) / m - l0) / m, np.array(ys[:m]) - l0

    def run(alpha, beta, gamma):
        zero, none = np.zeros(len(alpha)), np.zeros((len(alpha), m))
        level, trend, season = [zero + l0, zero + 1, zero, zero], [zero + b0, zero, zero + 1, zero], [none + s0, none.copy(), none.copy(), none + s0]
        sums = {x + z: zero for i, x in enumerate("cadg") for z in "cadg"[i:]}
        for t, y in enumerate(ys):
            now = [s[:, t % m].copy() for s in season]
            error = {"cadg"[k]: x - (level[k] + trend[k] + now[k]) for k, x in enumerate((y, 0.0, 0.0, 0.0))}
            sums = {k: v + error[k[0]] * error[k[1]] for k, v in sums.items()}
            for k, x in enumerate((y, 0.0, 0.0, 0.0)):
                up = alpha * (x - now[k]) + (1 - alpha) * (level[k] + trend[k])
                season[k][:, t % m] = gamma * (x - level[k] - trend[k]) + (1 - gamma) * now[k]
                level[k], trend[k] = up, beta * (up - level[k]) + (1 - beta) * trend[k]
        cc, ca, cd, cg, aa, ad, ag, dd, dg, gg = (sums[k] for k in ("cc", "ca", "cd", "cg", "aa", "ad", "ag", "dd", "dg", "gg"))
        det = aa * (dd * gg - dg * dg) - ad * (ad * gg - dg * ag) + ag * (ad * dg - dd * ag)
        fine, safe = det > 1e-9 * aa * dd * gg, np.where(det == 0, 1, det)
        dl, db, dk = (np.where(fine, -x / safe, 0.0) for x in (
            ca * (dd * gg - dg * dg) - ad * (cd * gg - dg * cg) + ag * (cd * dg - dd * cg),
            aa * (cd * gg - dg * cg) - ca * (ad * gg - dg * ag) + ag * (ad * cg - cd * ag),
            aa * (dd * cg - cd * dg) - ad * (ad * cg - cd * ag) + ca * (ad * dg - dd * ag)))
        sse = np.maximum(cc + dl * ca + db * cd + dk * cg, 0.0)
        fitted = [x[0] + dl * x[1] + db * x[2] + dk * x[3] for x in (level, trend)]
        return sse, [*fitted, season[0] + dl[:, None] * season[1] + db[:, None] * season[2] + dk[:, None] * season[3]]
    return run


def _fitted(series: DataFrame, schema: str, fit) -> DataFrame:
    """``fit(ys)`` for each tenant's series, in tasks; a tenant's row is few bytes and its work is its own."""
    def run(batches):
        for b in batches:
            rows = [fit(ys) for ys in b.column("ys").to_pylist()]
            out = pa.Table.from_pylist(rows, arrow).to_batches() if rows else []
            for part in out:
                yield pa.RecordBatch.from_arrays([b.column("tenant_id"), *part.columns], ["tenant_id", *part.schema.names])

    kind = series.schema["tenant_id"].dataType.simpleString()
    arrow = pa.schema([(n, {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in
                       (f.split(" ") for f in schema.split(", "))])
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.select("tenant_id", "ys").repartition(tasks, "tenant_id").mapInArrow(run, f"tenant_id {kind}, {schema}")


def fit_trend(series: DataFrame) -> DataFrame:
    """F2: best (alpha, beta) per tenant with fitted starting level and trend; state (level, trend) after the data."""
    def fit(ys):
        sse, (alpha, beta), (level, trend) = _refined(_trend_run(ys), 2, [i / 10.0 for i in TREND_GRID], TREND_STEPS, [-2, -1, 0, 1, 2])
        return {"alpha": alpha, "beta": beta, "level": float(level), "trend": float(trend), "sse": sse}
    return _fitted(series.where(F.col("n") >= 2), "alpha double, beta double, level double, trend double, sse double", fit)


def fit_seasonal(series: DataFrame) -> DataFrame:
    """best (alpha, beta, gamma) per tenant with period m and fitted starting level, trend and size of the season;
    keeps the seasonal state array for the forecast."""
    def fit(ys):
        m = min(SEASONAL_PERIODS_MAX, max(2, len(ys) // 2))
        sse, (alpha, beta, gamma), (level, trend, season) = _refined(
            _seasonal_run(ys, m), 3, [i / 10.0 for i in SEASONAL_GRID], SEASONAL_STEPS, [-1, 0, 1])
        return {"seasonal_periods": m, "alpha": alpha, "beta": beta, "gamma": gamma, "level": float(level), "trend": float(trend),
                "season": season.tolist(), "sse": sse}
    return _fitted(series.where(F.col("n") >= 4), "seasonal_periods int, alpha double, beta double, gamma double, level double, trend double, "
                   "season array<double>, sse double", fit)


def _status() -> Column:
    """the gate by the number of months with data and by whether they differ."""
    return (F.when(F.col("n") < FORECAST_MIN_MONTHS, F.lit("insufficient"))
             .when(F.size(F.array_distinct("ys")) == 1, F.lit("degenerate"))
             .when(F.col("n") < FORECAST_FULL_MONTHS, F.lit("realistic_only"))
             .otherwise(F.lit("full")))


def forecast_status(series: DataFrame) -> DataFrame:
    """gate per tenant."""
    status = _status()
    return series.select(
        "tenant_id", F.col("n").cast("long").alias("data_months_used"), status.alias("status"),
        (status == "full").alias("export_enabled"),
        (status == "full").alias("all_scenarios_available"))


def projections(series: DataFrame) -> DataFrame:
    """Projected (clamped) MRR for horizons 1..12 of every forecastable tenant.

    3-5 months: trend model. >= 6 months: seasonal model (falls back to the
    trend model only if no seasonal fit exists).
    """
    ok = series.withColumn("status", _status()).where(F.col("status").isin("realistic_only", "full"))
    # The trend model serves the 3-5 month forecasts; longer series use the
    # seasonal model (a grid fit always exists, so no fallback is needed).
    trend = fit_trend(ok.where(F.col("status") == "realistic_only"))
    seas = fit_seasonal(ok.where(F.col("status") == "full"))
    h = F.explode(F.sequence(F.lit(1), F.lit(FORECAST_HORIZON))).alias("horizon")
    base = ok.select("tenant_id", "n", "last_idx", "status", h)
    j = base.join(trend.select("tenant_id", F.col("level").alias("tl"), F.col("trend").alias("tb")), "tenant_id", "left") \
            .join(seas.select("tenant_id", "seasonal_periods", F.col("level").alias("sl"),
                              F.col("trend").alias("sb"), "season"), "tenant_id", "left")
    seasonal_val = F.col("sl") + F.col("horizon") * F.col("sb") + F.expr(
        "season[(n + horizon - 1) % seasonal_periods]")
    trend_val = F.col("tl") + F.col("horizon") * F.col("tb")
    use_seasonal = (F.col("status") == "full") & F.col("sl").isNotNull()
    projected = F.when(use_seasonal, seasonal_val).otherwise(trend_val)
    return j.select(
        "tenant_id", "horizon", "status",
        C.period_label(F.col("last_idx") + F.col("horizon")).alias("period"),
        F.when(use_seasonal, F.lit("holt_winters_additive")).otherwise(F.lit("holt_additive")).alias("model"),
        F.greatest(projected, F.lit(0.0)).alias("projected"))


def scenarios(proj: DataFrame, churn: DataFrame | None = None, churn_fraction: float | None = None) -> DataFrame:
    """Scenario rows. Churn: explicit fraction, else the tenant's
    churn rate / 100, else 0.05. 3-5 months: realistic only, unadjusted."""
    if churn_fraction is not None:
        c = F.lit(float(churn_fraction))
        p = proj
    elif churn is not None:
        p = proj.join(churn.select("tenant_id", "churn_rate"), "tenant_id", "left")
        c = F.coalesce(F.col("churn_rate") / 100, F.lit(FORECAST_CHURN_FALLBACK))
    else:
        p, c = proj, F.lit(FORECAST_CHURN_FALLBACK)
    # One pass: full forecasts expand to the three scenario factors, limited
    # ones to a single unadjusted "realistic" row (no union of two branches).
    full_rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in SCENARIO_FACTORS])
    limited_row = F.array(F.struct(F.lit("realistic").alias("scenario"), F.lit(None).cast("double").alias("k")))
    p = p.withColumn("_c", c).select(
        "*", F.inline(F.when(F.col("status") == "full", full_rows).otherwise(limited_row)))
    value = F.when(F.col("k").isNull(), F.col("projected")) \
             .otherwise(F.greatest(F.col("projected") * (1 - F.col("_c") * F.col("k")), F.lit(0.0)))
    return p.select("tenant_id", "horizon", "period", "scenario", value.alias("value"),
                    F.when(F.col("k").isNotNull(), F.col("_c")).alias("churn_rate_used"))


def forecast_endpoint(sc: DataFrame) -> DataFrame:
    """The 12th-month value per scenario."""
    return (sc.groupBy("tenant_id", "scenario")
              .agg(F.max_by("value", "horizon").alias("final_value"), F.max("period").alias("final_period")))


def report_forecast(sc: DataFrame) -> DataFrame:
    """One row per month, scenarios as columns, rounded to 2 places."""
    wide = sc.groupBy("tenant_id", "horizon", "period").pivot(
        "scenario", [n for n, _ in SCENARIO_FACTORS]).agg(F.first("value"))
    return wide.select("tenant_id", "horizon", "period",
                       *[F.round(F.col(n), 2).alias(n) for n, _ in SCENARIO_FACTORS])
