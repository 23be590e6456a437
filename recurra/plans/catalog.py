"""Named query plans: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
matching DuckDB oracle ``ORACLE[name]``.

Every plan reads the driver tables (or what Spark derives from them) in
full; none uses a row cap, id subset or sample unless that is the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions import columns as FCOL
from recurra.operators import clean as CL
from recurra.operators import metrics as MX
from recurra.plans import oracle as O
from recurra.session import fit_shuffles
from recurra.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (value-hash comparisons across engines)."""
    # "+ 0.0" turns a rounded -0.0 into 0.0 (the same on the SQL side).
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields])


# --- shared inputs -----------------------------------------------------------

def billing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw billing rows, with shuffles that fit their tables."""
    _input_key(spark, sf_dir)
    return tables.raw_billing_rows(spark, sf_dir)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean canonical facts derived from the driver tables."""
    return CL.clean(billing_rows(spark, sf_dir))


_ROLLUPS: dict[tuple, MX.Rollup] = {}
_FACT_ROWS: dict[tuple, int] = {}
#: Stored bytes that a fact row counts for at least.
FACT_BYTES = 18


def table_files(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Identity of input tables: path, length and modification time of every file, by Spark's file system."""
    key = [sf_dir.rstrip("/")]
    for t in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            key.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (key[0], *sorted(key[1:]))


def _input_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Identity of the billing tables; shuffles get as many partitions as their bytes or rows need."""
    key = table_files(spark, sf_dir, "lineitem", "orders", "customer")
    if key not in _FACT_ROWS:
        # From the files' footers: a table that compresses well is small stored, but its rows take as much memory as others.
        _FACT_ROWS[key] = tables.read_table(spark, sf_dir, "lineitem").count()
    fit_shuffles(spark, max(sum(length for _, length, _ in key[1:]), _FACT_ROWS[key] * FACT_BYTES))
    return key


def rollup_of(spark: SparkSession, sf_dir: str) -> MX.Rollup:
    """The materialized rollup of the billing facts, built once per input
    and session (like a materialized view) and shared by every metric,
    cohort, forecast, snapshot and report plan."""
    key = (id(spark), spark.sparkContext.applicationId, _input_key(spark, sf_dir))
    r = _ROLLUPS.get(key)
    if r is None:
        r = MX.Rollup(subscriptions(spark, sf_dir), materialize=True)
        _ROLLUPS[key] = r
    return r


def forget() -> None:
    """Forget the stored tables, so that the next query builds them anew."""
    for stored in (_ROLLUPS, _IDLE_MARKS, _UPLOADS):
        stored.clear()


# --- metrics (A, G, K, H) ------------------------------------------------------

def _last(cols: list[str]):
    def run(spark, sf_dir):
        m = rollup_of(spark, sf_dir).last()
        return round_doubles(m.select("tenant_id", "last_month", *cols))
    return run


def _by_month(cols: list[str]):
    def run(spark, sf_dir):
        m = rollup_of(spark, sf_dir).by_month()
        return round_doubles(m.select("tenant_id", "period", *cols))
    return run


ALL = O.METRIC_COLUMNS
register("all_metrics", O.last_metric_sql(ALL + ["last_month_is_fallback", "prev_month", "prev_month_status"]))(
    _last(ALL + ["last_month_is_fallback", "prev_month", "prev_month_status"]))
register("all_metrics_by_month", O.by_month_sql(ALL + ["last_month_is_fallback", "prev_month_status"]))(
    _by_month(ALL + ["last_month_is_fallback", "prev_month_status"]))

SINGLE_METRICS = {
    "mrr": ["mrr"], "arr": ["arr"], "arpu": ["arpu"], "total_revenue": ["total_revenue"],
    "new_mrr": ["new_mrr"], "new_subscribers": ["new_subscribers"],
    "reactivation_mrr": ["reactivation_mrr"], "reactivated_subscribers": ["reactivated_subscribers"],
    "growth_rate": ["growth_rate"], "churn_rate": ["churn_rate"],
    "voluntary_churn_rate": ["voluntary_churn_rate"], "involuntary_churn_rate": ["involuntary_churn_rate"],
    "revenue_churn": ["revenue_churn"], "nrr": ["nrr", "nrr_warning"], "ltv": ["ltv"],
    "active_subscribers": ["active_subscribers"], "lost_subscribers": ["lost_subscribers"],
    "existing_subscribers": ["existing_subscribers"],
    "prev_month_base": ["mrr_prev_month", "active_subscribers_prev_month"],
    "expansion_mrr": ["expansion_mrr"],
    "time_context": ["last_month_is_fallback", "prev_month", "prev_month_status"],
}
for _name, _cols in SINGLE_METRICS.items():
    register(_name, O.last_metric_sql(_cols))(_last(_cols))


@register("mrr_by_month", f"""WITH {O.FACTS}
SELECT tenant_id, {O.label('pidx')} AS period, round(CAST(mrr AS DOUBLE), 6) AS mrr FROM tm""")
def q_mrr_by_month(spark, sf_dir):
    """A5: monthly MRR series (months without paying rows absent)."""
    return _by_month(["mrr"])(spark, sf_dir)


@register("active_by_month", f"""WITH {O.FACTS}
SELECT tenant_id, {O.label('pidx')} AS period, CAST(n AS BIGINT) AS paying_customers FROM tm""")
def q_active_by_month(spark, sf_dir):
    """Distinct paying customers per month."""
    return _by_month(["paying_customers"])(spark, sf_dir)


# --- cohorts (B1-B7) -----------------------------------------------------------

from recurra.operators import cohort as CO  # noqa: E402

_COHORT_SQL = O.FACTS + f""",
coh AS (SELECT tenant_id, customer_id, min(pidx) AS cidx FROM pay GROUP BY tenant_id, customer_id),
sizes AS (SELECT tenant_id, cidx, count(*) AS size FROM coh GROUP BY tenant_id, cidx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY cidx DESC) AS cohort_rank,
                  count(*) OVER (PARTITION BY tenant_id) AS ncoh FROM sizes),
shown AS (SELECT tenant_id, cidx, size, cohort_rank FROM ranked WHERE ncoh >= 3 AND cohort_rank <= 12),
act AS (SELECT DISTINCT tenant_id, customer_id, pidx FROM s WHERE status = 'active' AND pidx IS NOT NULL),
ret AS (SELECT c.tenant_id, c.cidx, a.pidx - c.cidx AS month_n, count(*) AS retained
        FROM coh c JOIN shown sh ON sh.tenant_id = c.tenant_id AND sh.cidx = c.cidx
        JOIN act a ON a.tenant_id = c.tenant_id AND a.customer_id = c.customer_id AND a.pidx >= c.cidx
        GROUP BY c.tenant_id, c.cidx, a.pidx - c.cidx),
span AS (SELECT sh.tenant_id, min(sh.cidx) AS minc,
                (SELECT max(r.cidx + r.month_n) FROM ret r WHERE r.tenant_id = sh.tenant_id) AS maxp
         FROM shown sh GROUP BY sh.tenant_id),
grid0 AS (SELECT sh.tenant_id, sh.cidx, sh.size, sh.cohort_rank, sp.maxp,
                 unnest(generate_series(0, sp.maxp - sp.minc)) AS month_n
          FROM shown sh JOIN span sp ON sp.tenant_id = sh.tenant_id),
grid AS (SELECT g.tenant_id, {O.label('g.cidx')} AS cohort, g.cidx AS cohort_idx, CAST(g.size AS BIGINT) AS size,
                g.cohort_rank, CAST(g.month_n AS INTEGER) AS month_n,
                CAST(coalesce(r.retained, 0) AS BIGINT) AS retained,
                coalesce(r.retained, 0) / g.size * 100 AS pct_exact,
                g.cidx + g.month_n <= g.maxp AS is_observed
         FROM grid0 g LEFT JOIN ret r ON r.tenant_id = g.tenant_id AND r.cidx = g.cidx AND r.month_n = g.month_n)"""


def _hist(spark, sf_dir):
    return rollup_of(spark, sf_dir).allowed


@register("cohort_assignment", f"""WITH {O.FACTS}
SELECT tenant_id, customer_id, CAST(min(pidx) AS INTEGER) AS cohort_idx, {O.label('min(pidx)')} AS cohort
FROM pay GROUP BY tenant_id, customer_id""")
def q_cohort_assignment(spark, sf_dir):
    return CO.cohort_assignment(_hist(spark, sf_dir))


@register("cohort_selection", f"""WITH {_COHORT_SQL}
SELECT tenant_id, CAST(cidx AS INTEGER) AS cohort_idx, {O.label('cidx')} AS cohort, CAST(size AS BIGINT) AS size,
       CAST(cohort_rank AS INTEGER) AS cohort_rank FROM shown""")
def q_cohort_selection(spark, sf_dir):
    return CO.cohort_selection(_hist(spark, sf_dir))


@register("cohort_retention", f"""WITH {_COHORT_SQL}
SELECT tenant_id, CAST(cidx AS INTEGER) AS cohort_idx, CAST(month_n AS INTEGER) AS month_n,
       CAST(retained AS BIGINT) AS retained FROM ret""")
def q_cohort_retention(spark, sf_dir):
    return CO.cohort_retention(_hist(spark, sf_dir))


@register("cohort_grid", f"""WITH {_COHORT_SQL}
SELECT tenant_id, cohort, CAST(cohort_idx AS INTEGER) AS cohort_idx, size, CAST(cohort_rank AS INTEGER) AS cohort_rank,
       month_n, retained, round_even(pct_exact, 1) AS pct, round(pct_exact, 6) AS pct_exact, is_observed FROM grid""")
def q_cohort_grid(spark, sf_dir):
    return round_doubles(CO.cohort_grid(_hist(spark, sf_dir)))


@register("cohort_top_k", f"""WITH {_COHORT_SQL}
SELECT tenant_id, cohort, month_n, retained, round_even(pct_exact, 1) AS pct FROM grid WHERE cohort_rank <= 8""")
def q_cohort_top_k(spark, sf_dir):
    g = CO.cohort_top_k(CO.cohort_grid(_hist(spark, sf_dir)))
    return g.select("tenant_id", "cohort", "month_n", "retained", "pct")


@register("cohort_table", f"""WITH {_COHORT_SQL}
SELECT tenant_id, cohort, size, 'month_' || month_n AS month, round_even(pct_exact, 1) AS pct
FROM grid WHERE pct_exact IS NOT NULL""")
def q_cohort_table(spark, sf_dir):
    """Wide table (width = the largest tenant horizon, one scalar job), its cells listed by column name."""
    grid = materialize(spark, CO.cohort_grid(_hist(spark, sf_dir)), "cohort-grid")
    horizon = grid.agg(F.max("month_n")).first()[0]
    wide = CO.cohort_table(grid, int(horizon or 0))
    keys = ["tenant_id", "cohort", "size"]
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "month", "pct").where("pct IS NOT NULL")


# --- forecast (F1-F7, S13, S17) -------------------------------------------------

from recurra.operators import forecast as FC  # noqa: E402

def _fit_sql() -> str:
    """Both models by recursion over the months, a chain of tables per grid; the starting values in closed form."""
    def around(name, steps):
        return f"greatest(least(b.{name} + {steps}, {1 - FC.EDGE!r}), {FC.EDGE!r}) AS {name}"

    out, last = [], None
    for k, step in enumerate([None, *FC.TREND_STEPS]):
        values = ", ".join(f"({i / 10.0!r}::DOUBLE)" for i in FC.TREND_GRID) if step is None else ", ".join(f"({i * step!r}::DOUBLE)" for i in (-2, -1, 0, 1, 2))
        own = "a.v AS alpha, c.v AS beta" if step is None else f"{around('alpha', 'a.v')}, {around('beta', 'c.v')}"
        out.append(f"""
tp{k} AS (SELECT g.tenant_id, g.ys, g.n, {own} FROM gate g {'' if step is None else f'JOIN {last} b USING (tenant_id)'},
          (VALUES {values}) a(v), (VALUES {values}) c(v) WHERE g.status IN ('realistic_only', 'full')),
tf{k}(tenant_id, alpha, beta, t, l, b, la, ba, lb, bb, cc, ca, cd, aa, ad, dd) AS (
  SELECT tenant_id, alpha, beta, 1, ys[1], (ys[n] - ys[1]) / (n - 1), 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE,
         0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM tp{k}
  UNION ALL
  SELECT f.tenant_id, alpha, beta, t + 1,
         (alpha * s.ys[t] + (1 - alpha) * (l + b)), beta * ((alpha * s.ys[t] + (1 - alpha) * (l + b)) - l) + (1 - beta) * b,
         (alpha * 0.0::DOUBLE + (1 - alpha) * (la + ba)), beta * ((alpha * 0.0::DOUBLE + (1 - alpha) * (la + ba)) - la) + (1 - beta) * ba,
         (alpha * 0.0::DOUBLE + (1 - alpha) * (lb + bb)), beta * ((alpha * 0.0::DOUBLE + (1 - alpha) * (lb + bb)) - lb) + (1 - beta) * bb,
         cc + (s.ys[t] - (l + b)) * (s.ys[t] - (l + b)), ca + (s.ys[t] - (l + b)) * (-(la + ba)), cd + (s.ys[t] - (l + b)) * (-(lb + bb)),
         aa + (-(la + ba)) * (-(la + ba)), ad + (-(la + ba)) * (-(lb + bb)), dd + (-(lb + bb)) * (-(lb + bb))
  FROM tf{k} f JOIN series s ON s.tenant_id = f.tenant_id WHERE t <= s.n),
te{k} AS (SELECT f.*, aa * dd - ad * ad AS det FROM tf{k} f JOIN series s ON s.tenant_id = f.tenant_id WHERE f.t = s.n + 1),
tc{k} AS (SELECT *, CASE WHEN det > 1e-9 * aa * dd THEN (ad * cd - dd * ca) / det ELSE 0.0 END AS dl,
                 CASE WHEN det > 1e-9 * aa * dd THEN (ad * ca - aa * cd) / det ELSE 0.0 END AS db FROM te{k}),
tb{k} AS (SELECT DISTINCT ON (tenant_id) tenant_id, alpha, beta, l + dl * la + db * lb AS level, b + dl * ba + db * bb AS trend,
                 greatest(cc + dl * ca + db * cd, 0.0) AS sse FROM tc{k} ORDER BY tenant_id, sse, alpha, beta)""")
        last = f"tb{k}"
    out.append(f"""
tbest AS (SELECT * FROM {last}),
sp AS (SELECT g.*, least(12, greatest(2, g.n // 2)) AS m FROM gate g WHERE g.status = 'full'),
sp1 AS (SELECT *, list_reduce(ys[1:m], lambda a, x: a + x) / m AS l0 FROM sp),
sp2 AS (SELECT *, (list_reduce(ys[m + 1:2 * m], lambda a, x: a + x) / m - l0) / m AS b0,
               list_transform(ys[1:m], lambda x: x - l0) AS s0 FROM sp1)""")
    pairs = ["cc", "ca", "cd", "cg", "aa", "ad", "ag", "dd", "dg", "gg"]
    runs = {"c": ("", "q.ys[t + 1]"), "a": ("a", "0.0::DOUBLE"), "d": ("d", "0.0::DOUBLE"), "g": ("g", "0.0::DOUBLE")}
    moves, error = [], {}
    for k, (x, y) in runs.items():
        up = f"(alpha * ({y} - s{x}[t % m + 1]) + (1 - alpha) * (l{x} + b{x}))"
        moves.append(f"{up}, beta * ({up} - l{x}) + (1 - beta) * b{x}, "
                     f"list_transform(s{x}, lambda v, i: CASE WHEN i = t % m + 1 THEN gamma * ({y} - l{x} - b{x}) + (1 - gamma) * v ELSE v END)")
        error[k] = f"({y} - (l{x} + b{x} + s{x}[t % m + 1]))"
    last = None
    for k, step in enumerate([None, *FC.SEASONAL_STEPS]):
        values = ", ".join(f"({i / 10.0!r}::DOUBLE)" for i in FC.SEASONAL_GRID) if step is None else ", ".join(f"({i * step!r}::DOUBLE)" for i in (-1, 0, 1))
        own = "a.v AS alpha, c.v AS beta, d.v AS gamma" if step is None else f"{around('alpha', 'a.v')}, {around('beta', 'c.v')}, {around('gamma', 'd.v')}"
        zero = "list_transform(s0, lambda v: 0.0::DOUBLE)"
        out.append(f"""
sg{k} AS (SELECT p.*, {own} FROM sp2 p {'' if step is None else f'JOIN {last} b USING (tenant_id)'}, (VALUES {values}) a(v), (VALUES {values}) c(v), (VALUES {values}) d(v)),
sf{k}(tenant_id, m, alpha, beta, gamma, t, l, b, s, la, ba, sa, ld, bd, sd, lg, bg, sg, {', '.join(pairs)}) AS (
  SELECT tenant_id, m, alpha, beta, gamma, 0, l0, b0, s0, 1.0::DOUBLE, 0.0::DOUBLE, {zero}, 0.0::DOUBLE, 1.0::DOUBLE, {zero}, 0.0::DOUBLE, 0.0::DOUBLE, s0,
         {', '.join('0.0::DOUBLE' for _ in pairs)} FROM sg{k}
  UNION ALL
  SELECT f.tenant_id, f.m, alpha, beta, gamma, t + 1, {', '.join(moves)}, {', '.join(f'{x} + {error[x[0]]} * {error[x[1]]}' for x in pairs)}
  FROM sf{k} f JOIN series q ON q.tenant_id = f.tenant_id WHERE t < q.n),
se{k} AS (SELECT f.*, aa * (dd * gg - dg * dg) - ad * (ad * gg - dg * ag) + ag * (ad * dg - dd * ag) AS det
          FROM sf{k} f JOIN series q ON q.tenant_id = f.tenant_id WHERE f.t = q.n),
sc{k} AS (SELECT *, CASE WHEN det > 1e-9 * aa * dd * gg THEN -(ca * (dd * gg - dg * dg) - ad * (cd * gg - dg * cg) + ag * (cd * dg - dd * cg)) / det ELSE 0.0 END AS dl,
                 CASE WHEN det > 1e-9 * aa * dd * gg THEN -(aa * (cd * gg - dg * cg) - ca * (ad * gg - dg * ag) + ag * (ad * cg - cd * ag)) / det ELSE 0.0 END AS db,
                 CASE WHEN det > 1e-9 * aa * dd * gg THEN -(aa * (dd * cg - cd * dg) - ad * (ad * cg - cd * ag) + ca * (ad * dg - dd * ag)) / det ELSE 0.0 END AS dk FROM se{k}),
sb{k} AS (SELECT DISTINCT ON (tenant_id) tenant_id, m AS seasonal_periods, alpha, beta, gamma, l + dl * la + db * ld + dk * lg AS level,
                 b + dl * ba + db * bd + dk * bg AS trend, list_transform(s, lambda v, i: v + dl * sa[i] + db * sd[i] + dk * sg[i]) AS season,
                 greatest(cc + dl * ca + db * cd + dk * cg, 0.0) AS sse FROM sc{k} ORDER BY tenant_id, sse, alpha, beta, gamma)""")
        last = f"sb{k}"
    out.append(f"\nsbest AS (SELECT * FROM {last})")
    return ",".join(out).lstrip()


_FC_SQL = "WITH RECURSIVE " + O.LAST + """,
series AS (SELECT tenant_id, list(CAST(mrr AS DOUBLE) ORDER BY pidx) AS ys, count(*) AS n, max(pidx) AS last_idx
           FROM tm GROUP BY tenant_id),
gate AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN len(list_distinct(ys)) = 1 THEN 'degenerate'
                        WHEN n < 6 THEN 'realistic_only' ELSE 'full' END AS status FROM series),
""" + _fit_sql() + """,
proj AS (
  SELECT g.tenant_id, CAST(h.h AS INTEGER) AS horizon, g.status, """ + O.label("g.last_idx + h.h") + """ AS period,
         greatest(CASE WHEN g.status = 'full' THEN sb.level + h.h * sb.trend + sb.season[(g.n + h.h - 1) % sb.seasonal_periods + 1]
                       ELSE tb.level + h.h * tb.trend END, 0.0) AS projected
  FROM gate g JOIN range(1, 13) h(h) ON true
  LEFT JOIN tbest tb ON tb.tenant_id = g.tenant_id LEFT JOIN sbest sb ON sb.tenant_id = g.tenant_id
  WHERE g.status IN ('realistic_only', 'full')),
scen AS (
  SELECT p.tenant_id, p.horizon, p.period, k.scenario,
         greatest(p.projected * (1 - coalesce(ml.churn_rate / 100, 0.05) * k.k), 0.0) AS value,
         coalesce(ml.churn_rate / 100, 0.05) AS churn_rate_used
  FROM proj p JOIN metrics_last ml ON ml.tenant_id = p.tenant_id
  JOIN (VALUES ('pessimistic', 1.20), ('realistic', 1.00), ('optimistic', 0.80)) k(scenario, k) ON true
  WHERE p.status = 'full'
  UNION ALL
  SELECT p.tenant_id, p.horizon, p.period, 'realistic', p.projected, CAST(NULL AS DOUBLE)
  FROM proj p WHERE p.status = 'realistic_only')"""


def _series(spark, sf_dir):
    return FC.monthly_series(rollup_of(spark, sf_dir).base)


def _scenarios(spark, sf_dir):
    r = rollup_of(spark, sf_dir)
    series = FC.monthly_series(r.base)
    return FC.scenarios(FC.projections(series), churn=r.last())


@register("forecast_gate", _FC_SQL + """
SELECT tenant_id, CAST(n AS BIGINT) AS data_months_used, status, status = 'full' AS export_enabled,
       status = 'full' AS all_scenarios_available FROM gate""")
def q_forecast_gate(spark, sf_dir):
    return FC.forecast_status(_series(spark, sf_dir))


@register("forecast_gate_by_customer", "WITH " + O.FACTS + """,
pts AS (SELECT 'mrr|' || tenant_id || '|' || customer_id AS tenant_id, pidx, CAST(amt AS DOUBLE) AS y FROM pay
        UNION ALL SELECT 'active|' || tenant_id || '|' || customer_id, pidx, 1.0 FROM pay),
series AS (SELECT tenant_id, count(*) AS n, count(DISTINCT y) AS n_values FROM pts GROUP BY tenant_id),
gate AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN n_values = 1 THEN 'degenerate'
                        WHEN n < 6 THEN 'realistic_only' ELSE 'full' END AS status FROM series)
SELECT tenant_id, CAST(n AS BIGINT) AS data_months_used, status, status = 'full' AS export_enabled,
       status = 'full' AS all_scenarios_available FROM gate""")
def q_forecast_gate_by_customer(spark, sf_dir):
    """F1, F4 on every customer's monthly revenue and on their monthly activity (which never changes)."""
    paying = rollup_of(spark, sf_dir).allowed.where(F.col("is_paying") & F.col("period_idx").isNotNull())
    kinds = F.array(F.struct(F.lit("mrr").alias("kind"), F.col("paying_amt").alias("y")),
                    F.struct(F.lit("active").alias("kind"), F.lit(1).cast(FCOL.MONEY).alias("y")))
    base = paying.select("tenant_id", "customer_id", "period_idx", F.inline(kinds)).select(
        F.concat_ws("|", "kind", "tenant_id", "customer_id").alias("tenant_id"), "period_idx", F.col("y").alias("mrr"), F.lit(1).alias("n_paying"))
    return FC.forecast_status(FC.monthly_series(base))


@register("forecast_trend", _FC_SQL + """
SELECT t.tenant_id, round(t.alpha, 6) AS alpha, round(t.beta, 6) AS beta, round(t.level, 6) AS level, round(t.trend, 6) AS trend,
       round(sqrt(t.sse / s.n), 6) AS rmse FROM tbest t JOIN series s ON s.tenant_id = t.tenant_id""")
def q_forecast_trend(spark, sf_dir):
    s = _series(spark, sf_dir)
    ok = s.join(FC.forecast_status(s).where(F.col("status").isin("realistic_only", "full")).select("tenant_id"),
                "tenant_id")
    fit = FC.fit_trend(ok).join(ok.select("tenant_id", "n"), "tenant_id")
    return round_doubles(fit.select("tenant_id", "alpha", "beta", "level", "trend",
                                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse")))


@register("forecast_seasonal", _FC_SQL + """
SELECT b.tenant_id, b.seasonal_periods, round(b.alpha, 6) AS alpha, round(b.beta, 6) AS beta, round(b.gamma, 6) AS gamma, round(b.level, 6) AS level,
       round(b.trend, 6) AS trend, round(sqrt(b.sse / s.n), 6) AS rmse
FROM sbest b JOIN series s ON s.tenant_id = b.tenant_id""")
def q_forecast_seasonal(spark, sf_dir):
    s = _series(spark, sf_dir)
    full = s.join(FC.forecast_status(s).where(F.col("status") == "full").select("tenant_id"), "tenant_id")
    fit = FC.fit_seasonal(full).join(full.select("tenant_id", "n"), "tenant_id")
    return round_doubles(fit.select("tenant_id", "seasonal_periods", "alpha", "beta", "gamma", "level", "trend",
                                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse")))


@register("forecast_scenarios", _FC_SQL + """
SELECT tenant_id, horizon, period, scenario, round(value, 6) AS value, round(churn_rate_used, 6) AS churn_rate_used
FROM scen""")
def q_forecast_scenarios(spark, sf_dir):
    return round_doubles(_scenarios(spark, sf_dir))


@register("forecast_endpoint", _FC_SQL + """
SELECT tenant_id, scenario, round(arg_max(value, horizon), 6) AS final_value, max(period) AS final_period
FROM scen GROUP BY tenant_id, scenario""")
def q_forecast_endpoint(spark, sf_dir):
    return round_doubles(FC.forecast_endpoint(_scenarios(spark, sf_dir)))


@register("report_forecast", _FC_SQL + """
SELECT tenant_id, horizon, period,
       round(max(value) FILTER (WHERE scenario = 'pessimistic'), 2) AS pessimistic,
       round(max(value) FILTER (WHERE scenario = 'realistic'), 2) AS realistic,
       round(max(value) FILTER (WHERE scenario = 'optimistic'), 2) AS optimistic
FROM scen GROUP BY tenant_id, horizon, period""")
def q_report_forecast(spark, sf_dir):
    return FC.report_forecast(_scenarios(spark, sf_dir))


# --- what-if projection (P1-P5) -------------------------------------------------

from recurra.operators import scenario as SC  # noqa: E402

_SCEN_VALUES = ", ".join(f"('{n}', {float(c)!r}, {int(k)}, {float(p)!r})" for n, c, k, p in SC.DEFAULT_SCENARIOS)
_SCEN_SQL = "WITH " + O.LAST + f""",
inputs AS (SELECT scenario, CAST(c AS DOUBLE) AS churn_reduction, CAST(k AS BIGINT) AS new_customers_month,
                  CAST(p AS DOUBLE) AS price_increase FROM (VALUES {_SCEN_VALUES}) v(scenario, c, k, p)),
valid AS (SELECT * FROM inputs WHERE churn_reduction BETWEEN 0.0 AND 1.0 AND new_customers_month BETWEEN 0 AND 10000
                                 AND price_increase BETWEEN -0.5 AND 5.0),
pb AS (SELECT ml.tenant_id, ml.mrr AS base_mrr, ml.arpu AS base_arpu, coalesce(ml.churn_rate, 5.0) AS base_churn_rate,
              v.scenario, v.churn_reduction, v.new_customers_month, v.price_increase
       FROM metrics_last ml, valid v WHERE ml.arpu <> 0),
pc AS (SELECT *, base_churn_rate / 100.0 * (1 - churn_reduction) AS r, base_arpu * (1 + price_increase) AS new_arpu,
              base_mrr / base_arpu AS s0, CAST(m.month AS INTEGER) AS month
       FROM pb, range(1, 13) m(month)),
pd AS (SELECT *,
         greatest(s0 * pow(1 - r, month - 1) * new_arpu
                  + new_customers_month * new_arpu * (CASE WHEN r = 0 THEN CAST(month AS DOUBLE) ELSE (1 - pow(1 - r, month)) / r END), 0.0) AS mrr,
         CASE WHEN month = 1 THEN base_mrr ELSE
         greatest(s0 * pow(1 - r, month - 2) * new_arpu
                  + new_customers_month * new_arpu * (CASE WHEN r = 0 THEN CAST(month - 1 AS DOUBLE) ELSE (1 - pow(1 - r, month - 1)) / r END), 0.0) END AS prev,
         s0 * pow(1 - r, month - 1) + new_customers_month * (CASE WHEN r = 0 THEN CAST(month AS DOUBLE) ELSE (1 - pow(1 - r, month)) / r END) AS subs
       FROM pc),
proj AS (SELECT tenant_id, scenario, month, churn_reduction, new_customers_month, price_increase,
                base_mrr, base_arpu, base_churn_rate, r * 100 AS new_churn_rate, new_arpu, mrr,
                mrr - prev AS mrr_change, CASE WHEN prev <> 0 THEN (mrr - prev) / prev * 100.0 END AS mrr_change_pct,
                CAST(round_even(subs, 0) AS BIGINT) AS active_subscribers, new_customers_month AS new_customers_added,
                r * 100 AS effective_churn_rate FROM pd)"""


def _metrics_last(spark, sf_dir):
    return rollup_of(spark, sf_dir).last()


@register("scenario_projection", _SCEN_SQL + """
SELECT tenant_id, scenario, month, round(mrr, 6) AS mrr, round(new_arpu, 6) AS new_arpu,
       round(new_churn_rate, 6) AS new_churn_rate, round(base_mrr, 6) AS base_mrr FROM proj""")
def q_scenario_projection(spark, sf_dir):
    p = SC.projection(_metrics_last(spark, sf_dir))
    return round_doubles(p.select("tenant_id", "scenario", "month", "mrr", "new_arpu", "new_churn_rate", "base_mrr"))


@register("scenario_monthly", _SCEN_SQL + """
SELECT tenant_id, scenario, month, round(mrr, 6) AS mrr, round(mrr_change, 6) + 0.0 AS mrr_change,
       round(mrr_change_pct, 6) + 0.0 AS mrr_change_pct, active_subscribers, new_customers_added,
       round(effective_churn_rate, 6) AS effective_churn_rate FROM proj""")
def q_scenario_monthly(spark, sf_dir):
    p = SC.projection(_metrics_last(spark, sf_dir))
    return round_doubles(p.select("tenant_id", "scenario", "month", "mrr", "mrr_change", "mrr_change_pct",
                                  "active_subscribers", "new_customers_added", "effective_churn_rate"))


@register("scenario_summary", _SCEN_SQL + """
SELECT tenant_id, scenario, round(base_mrr, 6) AS base_mrr, round(arg_max(mrr, month), 6) AS final_mrr,
       round(CASE WHEN base_mrr <> 0 THEN (arg_max(mrr, month) - base_mrr) / base_mrr * 100.0 END, 6) + 0.0 AS mrr_change_pct
FROM proj GROUP BY tenant_id, scenario, base_mrr""")
def q_scenario_summary(spark, sf_dir):
    return round_doubles(SC.summary(SC.projection(_metrics_last(spark, sf_dir))))


@register("scenario_totals", _SCEN_SQL + """
SELECT tenant_id, scenario, round(avg(mrr), 6) AS avg_mrr, round(sum(mrr_change), 6) + 0.0 AS total_change
FROM proj GROUP BY tenant_id, scenario""")
def q_scenario_totals(spark, sf_dir):
    return round_doubles(SC.totals(SC.projection(_metrics_last(spark, sf_dir))))


@register("scenario_rejects", _SCEN_SQL + """
SELECT ml.tenant_id, i.scenario,
       concat_ws(', ', CASE WHEN NOT (i.churn_reduction BETWEEN 0.0 AND 1.0) THEN 'churn_reduction' END,
                       CASE WHEN NOT (i.new_customers_month BETWEEN 0 AND 10000) THEN 'new_customers_month' END,
                       CASE WHEN NOT (i.price_increase BETWEEN -0.5 AND 5.0) THEN 'price_increase' END,
                       CASE WHEN ml.arpu = 0 THEN 'zero_arpu' END) AS rejected_fields
FROM metrics_last ml, inputs i
WHERE NOT (i.churn_reduction BETWEEN 0.0 AND 1.0 AND i.new_customers_month BETWEEN 0 AND 10000
           AND i.price_increase BETWEEN -0.5 AND 5.0) OR ml.arpu = 0""")
def q_scenario_rejects(spark, sf_dir):
    return SC.rejects_by_tenant(_metrics_last(spark, sf_dir))


# --- snapshots (S1-S9, R5) ------------------------------------------------------

from recurra.operators import report as RP  # noqa: E402
from recurra.operators import snapshots as SN  # noqa: E402

_SNAP_SQL = "WITH " + O.LAST + """,
snaps AS (
  SELECT md5(tenant_id || '|' || period) AS snapshot_id, tenant_id AS user_id, period,
         mrr, arr, arpu, churn_rate, nrr, ltv, CAST(active_subscribers AS INTEGER) AS active_subscribers,
         total_revenue, 'billing' AS source,
         CAST(strptime(period || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH AS TIMESTAMP) AS created_at
  FROM bym2),
incoming AS (
  SELECT tenant_id AS user_id, last_month AS period, mrr, total_revenue, nrr, 'reupload' AS source,
         CAST(strptime(last_month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH + INTERVAL 1 DAY AS TIMESTAMP) AS created_at
  FROM metrics_last WHERE last_month IS NOT NULL),
upserted AS (
  SELECT coalesce(s.snapshot_id, md5(i.user_id || '|' || i.period)) AS snapshot_id,
         coalesce(s.user_id, i.user_id) AS user_id, coalesce(s.period, i.period) AS period,
         CASE WHEN i.user_id IS NOT NULL THEN i.mrr ELSE s.mrr END AS mrr, s.arr, s.arpu, s.churn_rate,
         CASE WHEN i.user_id IS NOT NULL THEN i.nrr ELSE s.nrr END AS nrr, s.ltv, s.active_subscribers,
         CASE WHEN i.user_id IS NOT NULL THEN i.total_revenue ELSE s.total_revenue END AS total_revenue,
         CASE WHEN i.user_id IS NOT NULL THEN i.source ELSE s.source END AS source,
         CASE WHEN i.user_id IS NOT NULL THEN i.created_at ELSE s.created_at END AS created_at
  FROM snaps s FULL OUTER JOIN incoming i ON s.user_id = i.user_id AND s.period = i.period),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS rn FROM snaps)"""

_SNAP_OUT = ("snapshot_id, user_id, period, round(mrr, 6) AS mrr, round(arr, 6) AS arr, round(arpu, 6) AS arpu, "
             "round(churn_rate, 6) AS churn_rate, round(nrr, 6) AS nrr, round(ltv, 6) AS ltv, active_subscribers, "
             "round(total_revenue, 6) AS total_revenue, source, created_at")


def _snaps(spark, sf_dir):
    return SN.snapshot_rows(rollup_of(spark, sf_dir).by_month())


def _incoming(spark, sf_dir):
    ml = rollup_of(spark, sf_dir).last().where(F.col("last_month").isNotNull())
    return ml.select(F.col("tenant_id").alias("user_id"), F.col("last_month").alias("period"),
                     "mrr", "total_revenue", "nrr", F.lit("reupload").alias("source"),
                     (SN.month_close(F.col("last_month")) + F.expr("INTERVAL 1 DAY")).alias("created_at"))


@register("snapshot_rows", _SNAP_SQL + f"\nSELECT {_SNAP_OUT} FROM snaps")
def q_snapshot_rows(spark, sf_dir):
    return round_doubles(_snaps(spark, sf_dir))


@register("snapshot_upsert", _SNAP_SQL + f"\nSELECT {_SNAP_OUT} FROM upserted")
def q_snapshot_upsert(spark, sf_dir):
    """Last-month re-upload (3 keys) merged into the monthly history."""
    return round_doubles(SN.upsert(_snaps(spark, sf_dir), _incoming(spark, sf_dir)))


@register("snapshot_rejects", _SNAP_SQL + """
SELECT user_id, period,
       CASE WHEN user_id IS NULL OR trim(user_id) = '' THEN 'blank_user_id'
            WHEN period IS NULL OR trim(period) = '' THEN 'blank_period'
            ELSE 'bad_period_format' END AS reject_reason
FROM snaps WHERE user_id IS NULL OR trim(user_id) = '' OR period IS NULL OR trim(period) = ''
              OR NOT regexp_full_match(period, '\\d{4}-\\d{2}')""")
def q_snapshot_rejects(spark, sf_dir):
    return SN.snapshot_rejects(_snaps(spark, sf_dir)).select("user_id", "period", "reject_reason")


def _broken_keys(spark, sf_dir):
    """The monthly snapshots as uploads that spell some keys wrongly (by the month of the row)."""
    s = _snaps(spark, sf_dir)
    m = F.substring("period", 6, 2)
    user = F.when(m == "02", F.lit(None)).when(m == "03", F.lit("  ")).otherwise(F.col("user_id"))
    period = (F.when(m == "05", F.lit(None)).when(m == "06", F.lit(" ")).when(m == "07", F.replace("period", F.lit("-"), F.lit("/")))
               .when(m == "08", F.concat("period", F.lit("-01"))).otherwise(F.col("period")))
    return s.withColumns({"user_id": user, "period": period})


_BROKEN_SQL = _SNAP_SQL + """,
broken AS (SELECT snapshot_id, mrr, CASE substr(period, 6, 2) WHEN '02' THEN NULL WHEN '03' THEN '  ' ELSE user_id END AS user_id,
                  CASE substr(period, 6, 2) WHEN '05' THEN NULL WHEN '06' THEN ' ' WHEN '07' THEN replace(period, '-', '/')
                                            WHEN '08' THEN period || '-01' ELSE period END AS period FROM snaps),
judged AS (SELECT *, CASE WHEN user_id IS NULL OR trim(user_id) = '' THEN 'blank_user_id'
                          WHEN period IS NULL OR trim(period) = '' THEN 'blank_period'
                          WHEN NOT regexp_full_match(period, '\\d{4}-\\d{2}') THEN 'bad_period_format' END AS reject_reason FROM broken)"""


@register("snapshot_upload_rejects", _BROKEN_SQL + """
SELECT snapshot_id, user_id, period, reject_reason FROM judged WHERE reject_reason IS NOT NULL""")
def q_snapshot_upload_rejects(spark, sf_dir):
    """S3 on uploads with blank and malformed keys."""
    return SN.snapshot_rejects(_broken_keys(spark, sf_dir)).select("snapshot_id", "user_id", "period", "reject_reason")


@register("snapshot_upload_valid", _BROKEN_SQL + """
SELECT snapshot_id, user_id, period, round(mrr, 6) AS mrr FROM judged WHERE reject_reason IS NULL""")
def q_snapshot_upload_valid(spark, sf_dir):
    """S3: the uploads that are stored."""
    return round_doubles(SN.valid_rows(_broken_keys(spark, sf_dir)).select("snapshot_id", "user_id", "period", "mrr"))


@register("snapshot_history", _SNAP_SQL + """
SELECT user_id, period, round(mrr, 6) AS mrr, round(churn_rate, 6) AS churn_rate, round(nrr, 6) AS nrr,
       round(arpu, 6) AS arpu FROM snaps""")
def q_snapshot_history(spark, sf_dir):
    return round_doubles(SN.history(_snaps(spark, sf_dir)))


@register("mom_deltas", _SNAP_SQL + """
SELECT c.user_id, c.period AS current_period, p.period AS previous_period,
       round(c.mrr, 6) AS current_mrr, round(p.mrr, 6) AS previous_mrr,
       round(CASE WHEN p.mrr IS NOT NULL AND p.mrr <> 0 THEN (c.mrr - p.mrr) / p.mrr * 100 END, 6) AS mrr_delta_pct,
       round(c.churn_rate, 6) AS current_churn_rate, round(p.churn_rate, 6) AS previous_churn_rate,
       round(c.churn_rate - p.churn_rate, 6) AS churn_delta_pp,
       round(c.nrr, 6) AS current_nrr, round(p.nrr, 6) AS previous_nrr, round(c.nrr - p.nrr, 6) AS nrr_delta_pp
FROM ranked c JOIN ranked p ON p.user_id = c.user_id AND c.rn = 1 AND p.rn = 2""")
def q_mom_deltas(spark, sf_dir):
    return round_doubles(SN.mom_deltas(_snaps(spark, sf_dir)))


@register("snapshot_trend", _SNAP_SQL + """
SELECT user_id, period, round(mrr, 6) AS mrr, round(churn_rate, 6) AS churn_rate FROM snaps""")
def q_snapshot_trend(spark, sf_dir):
    return round_doubles(SN.trend(_snaps(spark, sf_dir)))


@register("snapshot_table", _SNAP_SQL + """
SELECT user_id, period, round(mrr, 6) AS mrr, round(arpu, 6) AS arpu, round(churn_rate, 6) AS churn_rate,
       round(nrr, 6) AS nrr FROM snaps""")
def q_snapshot_table(spark, sf_dir):
    return round_doubles(SN.table(_snaps(spark, sf_dir)))


@register("snapshot_csv", _SNAP_SQL + """
SELECT user_id, period, active_subscribers, round(arpu, 6) AS arpu, round(arr, 6) AS arr,
       round(churn_rate, 6) AS churn_rate, round(ltv, 6) AS ltv, round(mrr, 6) AS mrr, round(nrr, 6) AS nrr,
       round(total_revenue, 6) AS total_revenue FROM snaps""")
def q_snapshot_csv(spark, sf_dir):
    """Export columns per user (the sink writes one ordered file per user folder)."""
    s = _snaps(spark, sf_dir)
    return round_doubles(s.select("user_id", *SN.csv_columns(s)))


@register("own_rows", _SNAP_SQL + """
SELECT user_id, period, round(mrr, 6) AS mrr FROM snaps
WHERE user_id = (SELECT min(user_id) FROM snaps)""")
def q_own_rows(spark, sf_dir):
    """The rows visible to one user (the first tenant by name)."""
    s = _snaps(spark, sf_dir)
    first_user = s.agg(F.min("user_id")).first()[0]
    rows = SN.visible_rows(spark, SN.register_visible(spark, s), first_user)
    return round_doubles(rows.select("user_id", "period", "mrr"))


# --- report tables (S10, S11, S15, S16, S19, X1) --------------------------------

_FMT_CUR = "CASE WHEN {v} IS NULL THEN 'N/A' ELSE (CASE WHEN {v} < 0 THEN '-' ELSE '' END) || '$' || format('{{:,.2f}}', abs({v})) END"
_FMT_PCT = "CASE WHEN {v} IS NULL THEN 'N/A' ELSE printf('%.2f', {v}) || '%' END"
_FMT_INT = "CASE WHEN {v} IS NULL THEN 'N/A' ELSE format('{{:,}}', CAST({v} AS BIGINT)) END"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _summary_sql() -> str:
    parts = []
    for block, order, key, label, kind in RP.SUMMARY_ROWS:
        v = f"CAST(ml.{key} AS DOUBLE)"
        txt = {"currency": _FMT_CUR, "pct": _FMT_PCT, "int": _FMT_INT}[kind].format(
            v=(v if kind != "int" else f"ml.{key}"))
        if key in RP.NA_WHEN_NULL:
            st = f"CASE WHEN {v} IS NULL THEN 'N/A' ELSE '✓' END"
        elif key == "nrr":
            st = f"CASE WHEN coalesce({v}, 0.0) > 200 THEN '⚠ >200%' ELSE '✓' END"
        elif key == "involuntary_churn_rate":
            st = f"CASE WHEN coalesce({v}, 0.0) > 0 THEN '🔧' ELSE '✓' END"
        else:
            st = "'✓'"
        parts.append(f"SELECT ml.tenant_id, {block} AS block, '{RP.BLOCK_NAMES[block]}' AS block_name, "
                     f"{order} AS row_order, '{key}' AS metric, '{label}' AS label, round({v}, 6) AS value, "
                     f"{txt} AS value_text, '{_q(RP.SUMMARY_NOTES[key])}' AS note, {st} AS status FROM metrics_last ml")
    return "WITH " + O.LAST + ",\nsummary AS (\n" + "\nUNION ALL\n".join(parts) + ")"


_SUMMARY_SQL = _summary_sql()


def _summary(spark, sf_dir):
    return RP.report_summary(_metrics_last(spark, sf_dir))


@register("report_summary", _SUMMARY_SQL + "\nSELECT * FROM summary")
def q_report_summary(spark, sf_dir):
    return round_doubles(_summary(spark, sf_dir))


@register("report_formatted", _SUMMARY_SQL + "\nSELECT tenant_id, metric, value_text FROM summary")
def q_report_formatted(spark, sf_dir):
    """Every metric rendered as the report shows it."""
    return _summary(spark, sf_dir).select("tenant_id", "metric", "value_text")


@register("report_by_plan", _SUMMARY_SQL + """
SELECT s.tenant_id, p.plan, s.block, s.metric, s.value_text FROM summary s
JOIN (VALUES ('free', 1), ('free', 2), ('starter', 1), ('starter', 2), ('starter', 3), ('starter', 4),
             ('pro', 1), ('pro', 2), ('pro', 3), ('pro', 4), ('pro', 5)) p(plan, block) ON p.block = s.block""")
def q_report_by_plan(spark, sf_dir):
    return RP.report_by_plan(_summary(spark, sf_dir)).select("tenant_id", "plan", "block", "metric", "value_text")


def _detail_sql() -> str:
    parts = []
    for i, (key, kind, formula) in enumerate(RP.DETAIL_ROWS):
        v = f"CAST(ml.{key} AS DOUBLE)"
        shown = {"currency": _FMT_CUR, "pct": _FMT_PCT, "int": _FMT_INT}[kind].format(v=v if kind != "int" else f"ml.{key}")
        parts.append(f"SELECT ml.tenant_id, {i + 1} AS row_order, '{key}' AS metric, round({v}, 6) AS raw_value, "
                     f"{shown} AS formatted_value, '{_q(formula)}' AS formula FROM metrics_last ml")
    return "WITH " + O.LAST + "\n" + "\nUNION ALL\n".join(parts)


@register("report_detail", _detail_sql())
def q_report_detail(spark, sf_dir):
    """The 19 detail rows per tenant."""
    return round_doubles(RP.report_detail(_metrics_last(spark, sf_dir)))


@register("metric_reconciliation", "WITH " + O.LAST + """,
chk AS (
  SELECT tenant_id, 'arr' AS metric, arr AS reported, mrr * 12 AS recomputed FROM metrics_last
  UNION ALL SELECT tenant_id, 'arpu', arpu, CASE WHEN active_subscribers > 0 THEN mrr / active_subscribers END FROM metrics_last
  UNION ALL SELECT tenant_id, 'growth_rate', growth_rate,
         CASE WHEN mrr_prev_month IS NOT NULL AND mrr_prev_month <> 0 THEN (mrr - mrr_prev_month) / mrr_prev_month * 100 END FROM metrics_last
  UNION ALL SELECT tenant_id, 'churn_rate', churn_rate,
         CASE WHEN active_subscribers_prev_month > 0 THEN lost_subscribers / active_subscribers_prev_month * 100 END FROM metrics_last
  UNION ALL SELECT tenant_id, 'nrr', nrr,
         CASE WHEN mrr_prev_month IS NOT NULL AND mrr_prev_month <> 0 THEN
              least(greatest((mrr - revenue_churn + coalesce(expansion_mrr, 0.0)) / mrr_prev_month * 100, 0.0), 999.0) END FROM metrics_last
  UNION ALL SELECT tenant_id, 'ltv', ltv,
         CASE WHEN churn_rate IS NULL OR churn_rate = 0 THEN arpu * 36 ELSE arpu / (churn_rate / 100) END FROM metrics_last
  UNION ALL SELECT tenant_id, 'lost_subscribers', CAST(lost_subscribers AS DOUBLE),
         CAST(active_subscribers_prev_month - existing_subscribers AS DOUBLE) FROM metrics_last)
SELECT tenant_id, metric, round(reported, 6) AS reported, round(recomputed, 6) AS recomputed,
       round(abs(reported - recomputed), 6) AS abs_diff,
       coalesce(abs(reported - recomputed) <= 1e-6, reported IS NULL AND recomputed IS NULL) AS consistent
FROM chk""")
def q_metric_reconciliation(spark, sf_dir):
    return round_doubles(RP.metric_reconciliation(_metrics_last(spark, sf_dir)))


@register("report_quality", "WITH " + O.LAST + f"""
SELECT tenant_id, 1 AS row_order, 'prev_month_status' AS flag, prev_month_status AS value,
       '{_q(RP.FLAG_MEANINGS["prev_month_status"])}' AS meaning FROM metrics_last
UNION ALL SELECT tenant_id, 2, 'last_month_is_fallback', CASE WHEN last_month_is_fallback THEN 'True' ELSE 'False' END,
       '{_q(RP.FLAG_MEANINGS["last_month_is_fallback"])}' FROM metrics_last
UNION ALL SELECT tenant_id, 3, 'last_month_used', coalesce(last_month, 'N/A'),
       '{_q(RP.FLAG_MEANINGS["last_month_used"])}' FROM metrics_last""")
def q_report_quality(spark, sf_dir):
    return RP.report_quality(_metrics_last(spark, sf_dir))


@register("data_quality_flags", "WITH " + O.LAST + """
SELECT tenant_id, prev_month_status, last_month_is_fallback, last_month AS last_month_used FROM metrics_last""")
def q_data_quality_flags(spark, sf_dir):
    """The flag record per tenant."""
    m = _metrics_last(spark, sf_dir)
    return m.select("tenant_id", "prev_month_status", "last_month_is_fallback",
                    F.col("last_month").alias("last_month_used"))


def _messages_sql(table: str, month: str, keys: str) -> str:
    return f"""
SELECT {keys}, 'prev_month_gap' AS code, 'warning' AS level,
       'The month before ' || coalesce({month}, 'N/A') || ' has no paying rows; comparisons are not available.' AS message
FROM {table} WHERE prev_month_status = 'gap'
UNION ALL SELECT {keys}, 'prev_month_missing', 'info',
       'There is no data before the last month; comparisons are not available.' FROM {table} WHERE prev_month_status = 'missing'
UNION ALL SELECT {keys}, 'last_month_fallback', 'warning',
       'Fewer than 5 paying customers in ' || coalesce({month}, 'N/A') || '; metrics may be unreliable.'
FROM {table} WHERE last_month_is_fallback
UNION ALL SELECT {keys}, 'nrr_above_200', 'warning',
       'NRR exceeds 200% - likely caused by limited prior-month data.' FROM {table} WHERE nrr_warning"""


@register("quality_messages", "WITH " + O.LAST + _messages_sql("metrics_last", "last_month", "tenant_id"))
def q_quality_messages(spark, sf_dir):
    return RP.quality_messages(_metrics_last(spark, sf_dir))


@register("quality_messages_by_month", "WITH " + O.BY_MONTH + _messages_sql("bym2", "period", "tenant_id, period AS last_month"))
def q_quality_messages_by_month(spark, sf_dir):
    """S16 for every month as if it were the last."""
    months = rollup_of(spark, sf_dir).by_month().withColumn("last_month", F.col("period"))
    return RP.quality_messages(months, ("tenant_id", "last_month"))


# --- session rules on events (T1, T2) --------------------------------------------

from recurra.session import materialize  # noqa: E402
from recurra.operators import sessions as SE  # noqa: E402

_SESS_OUT = """SELECT user_id, CAST(session_idx AS BIGINT) AS session_idx, min(ts) AS session_start,
       max(ts) AS session_end, count(*) AS n_events, round((max(t) - min(t)) / 1000000, 6) AS duration_seconds"""


_IDLE_MARKS: dict[tuple, DataFrame] = {}


def idle_marks_of(spark, sf_dir):
    """The T1 marking of the event log, materialized once per input and
    session (read by the idle and the max-age plans)."""
    ident = table_files(spark, sf_dir, "events")
    key = (id(spark), spark.sparkContext.applicationId, ident)
    if key not in _IDLE_MARKS:
        _IDLE_MARKS[key] = SE.mark_idle_sessions(tables.read_table(spark, sf_dir, "events"))
    return _IDLE_MARKS[key]


@register("sessions_idle", f"""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pt FROM e),
m AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 1800000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session_idx FROM l)
{_SESS_OUT} FROM m GROUP BY user_id, session_idx""")
def q_sessions_idle(spark, sf_dir):
    """Sessions split by inactivity strictly over 30 minutes."""
    return round_doubles(SE.summarize(idle_marks_of(spark, sf_dir)))


def _max_age_sql(idle_seconds: int, max_age_seconds: int) -> str:
    idle, age = idle_seconds * 1_000_000, max_age_seconds * 1_000_000
    over = f"e.t - w.start_t > {age} OR e.t - w.last_t > {idle}"
    return f"""WITH RECURSIVE
e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
walk(user_id, rn, t, start_t, last_t, session_idx) AS (
  SELECT user_id, rn, t, t, t, 1 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.t, CASE WHEN {over} THEN e.t ELSE w.start_t END, e.t,
         CASE WHEN {over} THEN w.session_idx + 1 ELSE w.session_idx END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1),
m AS (SELECT e.user_id, w.session_idx, e.ts, e.t FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn)
{_SESS_OUT} FROM m GROUP BY user_id, session_idx"""


@register("sessions_max_age", _max_age_sql(1800, 28800))
def q_sessions_max_age(spark, sf_dir):
    """T1 + T2: idle expiry plus the 8-hour maximum session age."""
    events = tables.read_table(spark, sf_dir, "events")
    return round_doubles(SE.summarize(SE.mark_sessions(events, idle_marked=idle_marks_of(spark, sf_dir))))


#: Limits under which the age rule fires on the event log (its users act every few hours).
SLOW_IDLE, SLOW_MAX_AGE = 24 * 3600, 72 * 3600


@register("sessions_max_age_slow", _max_age_sql(SLOW_IDLE, SLOW_MAX_AGE))
def q_sessions_max_age_slow(spark, sf_dir):
    """T1 + T2 with limits of a day and three days."""
    events = tables.read_table(spark, sf_dir, "events")
    return round_doubles(SE.summarize(SE.mark_sessions(
        events, idle_seconds=SLOW_IDLE, max_age_seconds=SLOW_MAX_AGE, chunk_seconds=SLOW_IDLE)))


# --- privacy, names, entitlements, feedback (E1-E4, R6-R7, S8) --------------------

from recurra.functions.constants import PII_PATTERNS  # noqa: E402
from recurra.operators import plan as PL  # noqa: E402
from recurra.operators import privacy as PV  # noqa: E402


def _re2(pattern: str) -> str:
    """The same pattern for RE2: Java's \\s set spelled out; the key
    pattern's look-arounds dropped (a match is already a maximal run)."""
    p = pattern.replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "")
    return p.replace("\\s", "[\\t\\n\\x0B\\f\\r ]")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scrub_sql(col: str) -> str:
    out = col
    for pattern, repl in PII_PATTERNS:
        out = f"regexp_replace({out}, {_sql_str(_re2(pattern))}, {_sql_str(repl)}, 'g')"
    return out


@register("pii_scrub", f"SELECT doc_id, {_scrub_sql('text')} AS text FROM documents")
def q_pii_scrub(spark, sf_dir):
    """Documents with e-mails, bearer tokens, token fields, keys and IPs redacted."""
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return PV.scrub_documents(docs)


@register("pii_scrub_conversations", f"SELECT conv_id, turn, role, {_scrub_sql('text')} AS text FROM conversations")
def q_pii_scrub_conversations(spark, sf_dir):
    conv = tables.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return PV.scrub_documents(conv)


@register("pii_scrub_map", f"""
SELECT conv_id, turn, 'role' AS field, {_scrub_sql('role')} AS value FROM conversations
UNION ALL SELECT conv_id, turn, 'text', {_scrub_sql('text')} FROM conversations
UNION ALL SELECT conv_id, turn, 'line_' || CAST(i - 1 AS VARCHAR), {_scrub_sql('ls[i]')}
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations) x,
     LATERAL generate_series(1, len(x.ls)) g(i)""")
def q_pii_scrub_map(spark, sf_dir):
    """A nested record per turn (map of fields + array of lines), every
    string inside scrubbed with transform_values / transform."""
    conv = tables.read_table(spark, sf_dir, "conversations")
    rec = conv.select("conv_id", "turn",
                      F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text")).alias("fields"),
                      F.split(F.col("text"), "\n", -1).alias("lines"))
    clean = rec.select("conv_id", "turn", PV.scrub_map(F.col("fields")).alias("fields"),
                       PV.scrub_array(F.col("lines")).alias("lines"))
    fields = clean.select("conv_id", "turn", F.explode("fields").alias("field", "value"))
    lines = clean.select("conv_id", "turn", F.posexplode("lines").alias("pos", "value")).select(
        "conv_id", "turn", F.concat(F.lit("line_"), F.col("pos").cast("string")).alias("field"), "value")
    return fields.unionByName(lines)


@register("pii_scrub_nested", f"""
WITH parts AS (SELECT conv_id, turn, role, i AS line_no, j AS part_no, p[j] AS part FROM (
  SELECT conv_id, turn, role, i, string_split(ls[i], '. ') AS p FROM (
    SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations WHERE text IS NOT NULL) x, LATERAL generate_series(1, len(x.ls)) g(i)) y,
  LATERAL generate_series(1, len(y.p)) h(j))
SELECT conv_id, turn, {_scrub_sql('role')} AS who, line_no::INTEGER AS line_no, part_no::INTEGER AS part_no, {_scrub_sql('part')} AS part FROM parts""")
def q_pii_scrub_nested(spark, sf_dir):
    """E3 at any depth: each turn as a record of a record of lines of parts, every string inside scrubbed by its type."""
    conv = tables.read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), F.split(x, r"\. ", -1).alias("parts")))
    rec = conv.select("conv_id", "turn", F.struct(F.create_map(F.lit("who"), F.col("role")).alias("about"), F.struct(lines.alias("lines")).alias("body")).alias("record"))
    clean = PV.scrub_columns(rec, "record")
    rows = clean.select("conv_id", "turn", F.col("record.about")["who"].alias("who"), F.explode("record.body.lines").alias("line"))
    return rows.select("conv_id", "turn", "who", "line.line_no", F.posexplode("line.parts").alias("at", "part")).select(
        "conv_id", "turn", "who", "line_no", (F.col("at") + 1).alias("part_no"), "part")


_WHO_SQL = "'user' || CAST(user_id AS VARCHAR) || '@mail.example.org'"
_TOKEN_SQL = "'Bearer abc' || CAST(event_id AS VARCHAR)"


@register("pii_scrub_json", f"""
SELECT event_id, {_scrub_sql(_WHO_SQL)} AS mail, {_scrub_sql(_TOKEN_SQL)} AS token, regexp_extract(props, ': ([0-9]+)', 1) AS k FROM events""")
def q_pii_scrub_json(spark, sf_dir):
    """E3 on JSON text: the props of each event beside its user's address and token, three levels deep, by no given schema."""
    e = tables.read_table(spark, sf_dir, "events")
    mail = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.example.org"))
    seen = F.array(F.struct(F.concat(F.lit("Bearer abc"), F.col("event_id").cast("string")).alias("token")))
    who = F.to_json(F.struct(F.struct(mail.alias("mail"), seen.alias("seen")).alias("who")))
    text = F.concat(F.lit('{"user":'), who, F.lit(',"props":'), F.col("props"), F.lit("}"))
    clean = PV.scrub_json(e.select("event_id", text.alias("record")), "record")
    found = [F.get_json_object("record", at).alias(n) for n, at in (("mail", "$.user.who.mail"), ("token", "$.user.who.seen[0].token"), ("k", "$.props.k"))]
    return clean.select("event_id", *found)


_PY_SPACE_RE2 = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in PV.PY_SPACE_CODEPOINTS)


@register("safe_name", f"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages),
k AS (SELECT page_id, title, lower(regexp_replace(regexp_replace(title, '[^\\pL\\pN_{_PY_SPACE_RE2}-]', '', 'g'),
                                          '[-{_PY_SPACE_RE2}]+', '_', 'g')) AS s FROM t)
SELECT page_id, title, CASE WHEN s IS NULL OR s = '' THEN 'report' ELSE s END AS safe_name FROM k""")
def q_safe_name(spark, sf_dir):
    """File-safe report names from page titles."""
    pages = tables.read_table(spark, sf_dir, "pages")
    t = pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return t.select("page_id", "title", PV.safe_name(F.col("title")).alias("safe_name"))


# Orders as the sales feed: product = order priority, refunded = a returned
# line, charged back = payment pending. Pro = urgent, starter = high.
PRO_PRODUCT, STARTER_PRODUCT = "1-URGENT", "2-HIGH"


def _sales(spark, sf_dir):
    orders = tables.read_table(spark, sf_dir, "orders")
    returned = (tables.read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
                .select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("refunded", F.lit(True)))
    return (orders.join(returned, "o_orderkey", "left")
                  .select(F.col("o_custkey").cast("string").alias("email"),
                          F.col("o_orderpriority").alias("product_id"),
                          F.coalesce("refunded", F.lit(False)).alias("refunded"),
                          (F.col("o_orderstatus") == "P").alias("chargedback")))


def _plans(spark, sf_dir):
    users = tables.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("email"))
    return PL.plan_from_sales(users, _sales(spark, sf_dir), PRO_PRODUCT, STARTER_PRODUCT)


_PLAN_SQL = """WITH sales AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS email, o.o_orderpriority AS product_id,
         EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS refunded,
         o.o_orderstatus = 'P' AS chargedback FROM orders o),
best AS (SELECT email, max(CASE WHEN product_id = '1-URGENT' THEN 2 WHEN product_id = '2-HIGH' THEN 1 ELSE 0 END) AS r
         FROM sales WHERE NOT refunded AND NOT chargedback GROUP BY email),
plans AS (SELECT CAST(c.c_custkey AS VARCHAR) AS email,
                 CASE b.r WHEN 2 THEN 'pro' WHEN 1 THEN 'starter' ELSE 'free' END AS plan
          FROM customer c LEFT JOIN best b ON b.email = CAST(c.c_custkey AS VARCHAR))"""


@register("plan_from_sales", _PLAN_SQL + "\nSELECT email, plan FROM plans")
def q_plan_from_sales(spark, sf_dir):
    """Plan per customer from their order feed."""
    return _plans(spark, sf_dir)


@register("plan_lookup", _PLAN_SQL + "\nSELECT email, plan FROM plans")
def q_plan_lookup(spark, sf_dir):
    """One plan per user from the plan table (unknown -> free)."""
    return PL.plan_lookup(_plans(spark, sf_dir))


@register("plan_lookup_orders", """
SELECT email, CASE WHEN plan IN ('free', 'starter', 'pro') THEN plan ELSE 'free' END AS plan FROM (
  SELECT email, plan, row_number() OVER (PARTITION BY email ORDER BY plan NULLS LAST) AS rn FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS email,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'pro' WHEN '2-HIGH' THEN 'starter' WHEN '3-MEDIUM' THEN 'free'
                                WHEN '4-NOT SPECIFIED' THEN 'gold' END AS plan FROM orders) p) x
WHERE rn = 1""")
def q_plan_lookup_orders(spark, sf_dir):
    """R7 where users have several rows, unknown plans and missing ones: one row per order."""
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "pro", "2-HIGH", "starter", "3-MEDIUM", "free", "4-NOT SPECIFIED", "gold")])
    return PL.plan_lookup(tables.read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("email"), F.element_at(names, F.col("o_orderpriority")).alias("plan")))


def _rated(spark, sf_dir):
    """Events as rated feedback: the rating is the value's tens (none for views), the text the event type (blank for errors)."""
    ev = tables.read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("feedback_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_email"),
                     F.when(F.col("event_type") != "view", F.floor(F.col("value") / 10).cast("int")).alias("rating"),
                     F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type")).alias("message"),
                     F.col("ts").alias("created_at"))


_RATED_SQL = """WITH fb AS (
  SELECT event_id AS feedback_id, 'user-' || CAST(user_id AS VARCHAR) AS user_email,
         CASE WHEN event_type <> 'view' THEN CAST(floor(value / 10) AS INTEGER) END AS rating,
         CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS message, ts AS created_at FROM events),
judged AS (SELECT *, CASE WHEN rating IS NULL AND coalesce(trim(message), '') = '' THEN 'empty'
                          WHEN rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5 THEN 'rating_out_of_range' END AS reject_reason
           FROM fb)"""


@register("feedback_rating_rejects", _RATED_SQL + "\nSELECT feedback_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL")
def q_feedback_rating_rejects(spark, sf_dir):
    """S8 with ratings in and out of range."""
    return PL.feedback_rejects(_rated(spark, sf_dir)).select("feedback_id", "reject_reason")


@register("feedback_rating_history", _RATED_SQL + """
SELECT user_email, rating, trim(message) AS message, created_at FROM judged WHERE reject_reason IS NULL""")
def q_feedback_rating_history(spark, sf_dir):
    """R6 with ratings."""
    return PL.feedback_history(_rated(spark, sf_dir))


def _feedback(spark, sf_dir):
    """User turns of the conversation log as free-text feedback messages."""
    conv = tables.read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("feedback_id"),
                       F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("user_email"),
                       F.lit(None).cast("int").alias("rating"), F.col("text").alias("message"),
                       F.col("turn").alias("created_at"))


@register("feedback_rejects", """
SELECT conv_id * 1000 + turn AS feedback_id, 'empty' AS reject_reason FROM conversations
WHERE role = 'user' AND (text IS NULL OR length(trim(text)) = 0)""")
def q_feedback_rejects(spark, sf_dir):
    """Submissions without a rating and without text (or bad ratings)."""
    return PL.feedback_rejects(_feedback(spark, sf_dir)).select("feedback_id", "reject_reason")


@register("feedback_history", """
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS user_email, CAST(NULL AS INTEGER) AS rating, trim(text) AS message,
       turn AS created_at FROM conversations
WHERE role = 'user' AND text IS NOT NULL AND length(trim(text)) > 0""")
def q_feedback_history(spark, sf_dir):
    """Accepted feedback per user, newest first."""
    return PL.feedback_history(_feedback(spark, sf_dir))


# --- ingest of CSV exports, schema resolution, cleaning (R1-R4, M1-M9, C1-C12) ----

from recurra.operators import mapping as MP  # noqa: E402
from recurra.sources import csv_exports as CX  # noqa: E402


_UPLOADS: dict[tuple, CX.Uploads] = {}


def _uploads(spark, sf_dir) -> tuple[str, CX.Uploads]:
    """The export files of the input and their stored lines, built once per input and session."""
    ident = _input_key(spark, sf_dir)
    key = (spark.sparkContext.applicationId, ident)
    path = CX.ensure_exports(spark, ident, billing_rows(spark, sf_dir))
    if key not in _UPLOADS:
        _UPLOADS[key] = CX.Uploads(spark, path)
    return path, _UPLOADS[key]


def _ingested(spark, sf_dir, strict=False, store=True):
    path, uploads = _uploads(spark, sf_dir)
    return CX.ingest(spark, path, strict, uploads, store=store)


LINK_LABEL = '<a href="/[^"]*">([^<]*)</a>'


def _catalog(spark, sf_dir):
    """Column names to resolve: the headers of the uploads, and the navigation labels of every page."""
    _, uploads = _uploads(spark, sf_dir)
    headers = uploads.catalog(CX.upload_of(F.col("file"))[0])
    labels = tables.read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"),
        F.posexplode(F.regexp_extract_all("html", F.lit(LINK_LABEL), F.lit(1))).alias("ordinal", "column"))
    return headers.unionByName(labels)


def _layout_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CX.LAYOUT_BY_INITIAL.items())
    return f"CASE upper(substr({col}, 1, 1)) {whens} ELSE 'manual' END"


_HEADER_VALUES = ", ".join(f"('{layout}', {i}, '{name}')" for layout, h in CX.LAYOUTS.items()
                           for i, name in enumerate(h.values()))
_CATALOG_SQL = O.FACTS + f""",
uploads AS (SELECT DISTINCT tenant_id AS source_id, {_layout_case('tenant_id')} AS layout FROM raw),
headers AS (SELECT * FROM (VALUES {_HEADER_VALUES}) h(layout, ordinal, "column")),
links AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS source_id, regexp_extract_all(html, '{LINK_LABEL}', 1) AS names FROM pages),
catalog AS (SELECT u.source_id, CAST(h.ordinal AS INTEGER) AS ordinal, h."column" FROM headers h
            JOIN uploads u ON u.layout = h.layout
            UNION ALL
            SELECT source_id, CAST(unnest(range(len(names))) AS INTEGER), unnest(names) FROM links),
san AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(lower("column"), '^[\\s]+|[\\s]+$', '', 'g'), '[\\s\\-.]+', '_', 'g'),
          '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS sanitized FROM catalog)"""

# The exports' rows as they must come back: the long lines are dropped.
_LONG = (f"{_layout_case('tenant_id')} IN ({', '.join(repr(x) for x in CX.LONG_LINE_LAYOUTS)}) "
         "AND src_line = 5 AND src_order % 4 = 0")
_UP_CTES = f"""
up AS (SELECT *, {_layout_case('tenant_id')} AS layout, src_order // {CX.CHUNK_ORDERS} AS chunk, ({_LONG}) AS too_long,
              CASE WHEN copy = 2 THEN 'active' WHEN status = 'active' THEN 'Active' WHEN status = 'churned' THEN 'cancelled' ELSE 'Payment Failed' END AS spelled
       FROM (SELECT *, 0 AS copy FROM raw UNION ALL SELECT *, 1 FROM raw WHERE src_line = 6 AND src_order % 5 = 0
             UNION ALL SELECT *, 2 FROM raw WHERE src_line = 7 AND src_order % 5 = 1 AND status = 'active')),
words AS (
  SELECT *, CASE WHEN src_line = 2 AND src_order % 3 = 0 THEN '  ' || customer_id || ' ' || chr(160) ELSE customer_id END AS id_text,
         CASE WHEN src_line = 1 AND src_order % 11 = 0 THEN '$' ELSE '' END || printf('%.2f', amount)
           || CASE WHEN src_line = 1 AND src_order % 13 = 0 AND src_order % 11 <> 0 THEN 'd' ELSE '' END AS amount_text,
         CASE WHEN layout IN ('stripe', 'lemonsqueezy') = (src_line = 3 AND src_order % 9 = 0) THEN strftime(date, '%Y-%m-%d')
              WHEN layout = 'lemonsqueezy' THEN strftime(date, '%d/%m/%Y') ELSE strftime(date, '%m/%d/%Y') END AS day,
         CASE layout WHEN 'chargebee' THEN 'Счёт' WHEN 'lemonsqueezy' THEN 'Café' || chr(152) ELSE 'Facture é' END AS word FROM up),
cells AS (
  SELECT *, CASE WHEN src_line = 2 OR (src_line = 4 AND src_order % 3 = 0) THEN NULL
                 WHEN src_line = 1 THEN word || ', "' || spelled || '", 1'
                 WHEN src_line = 3 THEN word || chr(10) || 'line 2, "x"' || chr(10) || ' ' || chr(10) || 'end' ELSE word END AS memo FROM words)"""
_UP_SQL = O.FACTS + "," + _UP_CTES
_UP_OUT = """
SELECT tenant_id, id_text AS customer_id, day AS date, amount_text AS amount, spelled AS status, currency,
       CAST(src_order AS VARCHAR) AS order_ref, CAST(src_line AS VARCHAR) AS line_no, memo
FROM cells"""
# What is left after the copies are gone, in the format of each file's first date.
_UP_TYPED = _UP_CTES + """,
firsts AS (SELECT tenant_id, chunk, first(day ORDER BY src_order, src_line, copy, day) AS first_day FROM cells WHERE NOT too_long GROUP BY ALL),
clean_rows AS (
  SELECT c.tenant_id, c.customer_id, TRY_CAST(amount_text AS DOUBLE) AS amount, c.status, c.currency, c.src_order, c.src_line, c.copy, c.layout,
         CASE WHEN first_day LIKE '____-%' THEN try_strptime(day, '%Y-%m-%d')
              WHEN CAST(substr(first_day, 1, 2) AS INTEGER) > 12 THEN try_strptime(day, '%d/%m/%Y')
              ELSE try_strptime(day, '%m/%d/%Y') END AS date
  FROM cells c JOIN firsts USING (tenant_id, chunk) WHERE NOT too_long AND copy <> 1)"""


def _with_extras(rows):
    return rows.select("tenant_id", *CL.CANONICAL, *[CX.extra(n).alias(n) for n in CX.EXTRAS.values()])


@register("ingest_csv", "WITH " + _UP_SQL + _UP_OUT + " WHERE NOT too_long")
def q_ingest_csv(spark, sf_dir):
    """R1 + M7: the exports read back (all strings), renamed to the canonical fields, other columns kept."""
    return _with_extras(_ingested(spark, sf_dir, store=False))


@register("ingest_csv_strict", "WITH " + _UP_SQL + _UP_OUT + """ c
WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.too_long AND u.tenant_id = c.tenant_id AND u.chunk = c.chunk)""")
def q_ingest_csv_strict(spark, sf_dir):
    """R2: files with a malformed line are refused whole."""
    return _with_extras(_ingested(spark, sf_dir, strict=True, store=False))


@register("ingest_metrics", O.last_metric_sql(ALL + ["last_month_is_fallback", "prev_month", "prev_month_status"]).replace(
    "subs AS (SELECT DISTINCT * FROM raw)", _UP_TYPED.lstrip() + ",\nsubs AS (SELECT tenant_id, customer_id, date, amount, status, currency FROM clean_rows)"))
def q_ingest_metrics(spark, sf_dir):
    """End to end as the upload flow: CSV exports -> mapping -> clean -> metrics."""
    m = MX.metrics_last(MX.Rollup(CL.clean_by_customer(_ingested(spark, sf_dir)), materialize=True))
    return round_doubles(m.select("tenant_id", "last_month", *ALL,
                                  "last_month_is_fallback", "prev_month", "prev_month_status"))


@register("file_manifest", "WITH " + _UP_SQL + """
SELECT DISTINCT tenant_id, chunk, CAST(NULL AS VARCHAR) AS reject_reason, true AS accepted FROM up
UNION ALL SELECT * FROM (VALUES ('r-empty', 0::BIGINT, 'empty', false), ('r-note', 0, 'not_csv', false), ('r-large', 0, 'too_large', false),
                                ('r-blank', 0, NULL, true), ('r-header', 0, NULL, true), ('r-open', 0, NULL, true)) r(tenant_id, chunk, reject_reason, accepted)""")
def q_file_manifest(spark, sf_dir):
    """Upload guards over the export files."""
    files = CX.file_manifest(spark, _uploads(spark, sf_dir)[0] + "/charset=*")
    return files.select(*CX.upload_of(F.col("path")), "reject_reason", "accepted")


@register("file_encoding_report", "WITH " + _UP_SQL + """
SELECT DISTINCT tenant_id, chunk, CASE layout WHEN 'paddle' THEN 'utf-8-sig' WHEN 'chargebee' THEN 'cp1251'
                                              WHEN 'lemonsqueezy' THEN 'latin-1' ELSE 'utf-8' END AS encoding,
       layout = 'lemonsqueezy' AS encoding_warning FROM up""")
def q_file_encoding_report(spark, sf_dir):
    """Encoding per export file."""
    return _uploads(spark, sf_dir)[1].encodings().select(*CX.upload_of(F.col("file")), "encoding", "encoding_warning")


@register("upload_rejects", "WITH " + _UP_SQL + """
SELECT * FROM (VALUES ('r-blank', 0::BIGINT, 'no_columns'), ('r-header', 0, 'no_rows'), ('r-open', 0, 'unclosed_quote')) r(tenant_id, chunk, reject_reason)
WHERE EXISTS (SELECT 1 FROM up)""")
def q_upload_rejects(spark, sf_dir):
    """Files that pass the guards and hold no table."""
    return _uploads(spark, sf_dir)[1].rejects().select(*CX.upload_of(F.col("file")), "reject_reason")


@register("upload_dedup", "WITH " + _UP_SQL + """
SELECT tenant_id, id_text AS customer_id, day AS date, amount_text AS amount, spelled AS status, CAST(src_order AS VARCHAR) AS order_ref,
       CAST(src_line AS VARCHAR) AS line_no, count(*) AS n_copies FROM cells WHERE NOT too_long GROUP BY ALL""")
def q_upload_dedup(spark, sf_dir):
    """C1 on uploads: each distinct row once, as it was written, with its multiplicity; respelled twins stay."""
    return CL.distinct_rows(_ingested(spark, sf_dir)).select(
        "n_copies", "tenant_id", "customer_id", "first.date", "first.amount", "status", *[CX.extra(n).alias(n) for n in ("order_ref", "line_no")])


@register("upload_clean", "WITH " + O.FACTS + "," + _UP_TYPED + """
SELECT tenant_id, customer_id, date, round(amount, 6) AS amount, status, currency, CASE WHEN src_line = 6 AND src_order % 5 = 0 THEN 2::BIGINT ELSE 1 END AS n_copies FROM clean_rows""")
def q_upload_clean(spark, sf_dir):
    """C1-C5 on uploads: one date format per file, bad amounts NULL, ids without blanks, canonical status."""
    return round_doubles(CL.clean(_ingested(spark, sf_dir)).select("tenant_id", *CL.CANONICAL, "n_copies"))


@register("upload_cleaning_report", "WITH " + O.FACTS + "," + _UP_TYPED + """
SELECT c.tenant_id, c.n AS rows_before, c.copies AS duplicates_removed, r.zeros AS zeros_count, r.negs AS negatives_count,
       c.n - c.copies AS rows_after, r.latin AS encoding_warning, r.ncur > 1 AS multicurrency_error
FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE copy = 1) AS copies FROM cells WHERE NOT too_long GROUP BY tenant_id) c
JOIN (SELECT tenant_id, count(*) FILTER (WHERE amount = 0) AS zeros, count(*) FILTER (WHERE amount < 0) AS negs,
             count(DISTINCT currency) AS ncur, bool_or(layout = 'lemonsqueezy') AS latin FROM clean_rows GROUP BY tenant_id) r USING (tenant_id)""")
def q_upload_cleaning_report(spark, sf_dir):
    """C9 on uploads: copies, zero and negative amounts, the encoding warning of R3 and the currency guard."""
    return CL.cleaning_report(_ingested(spark, sf_dir))


@register("sanitize_names", "WITH " + _CATALOG_SQL + """
SELECT source_id, ordinal, "column", sanitized FROM san""")
def q_sanitize_names(spark, sf_dir):
    """M1: sanitised names of every header and page."""
    return MP.sanitized_catalog(_catalog(spark, sf_dir))


from recurra.functions.constants import BLOCKLIST, FIELD_ORDER, FIELD_SYNONYMS, PRESET_SIGNATURES  # noqa: E402

# One table row per character of the name; rows and characters are lists of integers, as a fold's state has its items' type.
_LCS = """CASE WHEN len(sanitized) = 0 THEN 0 ELSE list_reduce(
    list_transform(string_split(sanitized, ''), lambda c: [ascii(c)]),
    lambda prev, ca: list_reduce(
      list_transform(range(1, len(synonym) + 1), lambda j: [CAST(j AS INTEGER)]),
      lambda cur, j: list_append(cur, CASE WHEN ca[1] = ascii(synonym[j[1]]) THEN prev[j[1]] + 1
                                           ELSE greatest(prev[j[1] + 1], cur[j[1]]) END), [0]),
    list_transform(range(0, len(synonym) + 1), lambda j: 0))[len(synonym) + 1] END"""
_SYN_VALUES = ", ".join(f"('{f}', {FIELD_ORDER.index(f)}, '{x}')" for f in FIELD_ORDER for x in FIELD_SYNONYMS[f])
_SCORE_SQL = "WITH " + _CATALOG_SQL + f""",
usable AS (SELECT * FROM san WHERE sanitized NOT IN ({', '.join(repr(x) for x in BLOCKLIST)})),
pairs AS (SELECT n.sanitized, y.field, y.field_rank, y.synonym FROM (SELECT DISTINCT sanitized FROM usable) n,
                 (VALUES {_SYN_VALUES}) y(field, field_rank, synonym)),
by_name AS (SELECT sanitized, field, field_rank, max(200.0::DOUBLE * ({_LCS}) / (len(sanitized) + len(synonym))) AS score,
                   bool_or(sanitized = synonym) AS exact FROM pairs GROUP BY sanitized, field, field_rank),
scores AS (SELECT u.source_id, u.ordinal, u."column", u.sanitized, b.field, b.field_rank, b.score, b.exact
           FROM usable u JOIN by_name b ON b.sanitized = u.sanitized),
near AS (SELECT * FROM scores WHERE exact OR score >= 75)"""


def _greedy_sql() -> str:
    sql, taken = _SCORE_SQL, ""
    for i, f in enumerate(FIELD_ORDER):
        free = f" AND NOT EXISTS (SELECT 1 FROM ({taken}) a WHERE a.source_id = n.source_id AND a.ordinal = n.ordinal)" if taken else ""
        sql += f""",
pick{i} AS (SELECT source_id, field, ordinal, "column", CASE WHEN exact THEN 100.0 ELSE score END AS score FROM (
  SELECT n.*, row_number() OVER (PARTITION BY source_id ORDER BY exact DESC, score DESC, ordinal) AS rn
  FROM near n WHERE field = '{f}'{free}) x WHERE rn = 1)"""
        taken = " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(i + 1))
    return sql + f",\nmapped AS ({taken})"


@register("name_match_scores", _SCORE_SQL + """
SELECT source_id, ordinal, "column", sanitized, field, field_rank, round(score, 6) AS score, exact FROM scores""")
def q_name_match_scores(spark, sf_dir):
    """M2/M3: fuzzy scores per (column, field), blocklisted columns removed."""
    return round_doubles(MP.name_match_scores(_catalog(spark, sf_dir)))


@register("auto_map_columns", _greedy_sql() + """
SELECT source_id, field, ordinal, "column", round(score, 6) AS score FROM mapped""")
def q_auto_map_columns(spark, sf_dir):
    """M4: greedy one-to-one fuzzy mapping per source."""
    return round_doubles(MP.auto_map_columns(_catalog(spark, sf_dir)))


_PRESET_VALUES = ", ".join(f"('{name}', {rank}, '{field}', '{col}')"
                           for rank, (name, sig) in enumerate(PRESET_SIGNATURES) for field, col in sig.items())
_PRESET_SQL = "WITH " + _CATALOG_SQL + f""",
sigs AS (SELECT * FROM (VALUES {_PRESET_VALUES}) s(preset, preset_rank, field, signature_column)),
hits AS (SELECT c.source_id, s.preset, s.preset_rank, count(DISTINCT s.field) AS n
         FROM catalog c JOIN sigs s ON s.signature_column = lower(trim(c."column"))
         GROUP BY c.source_id, s.preset, s.preset_rank),
presets AS (SELECT source_id, arg_min(preset, preset_rank) AS preset FROM hits WHERE n = 4 GROUP BY source_id),
pmap AS (
  SELECT source_id, field, ordinal, "column" FROM (
    SELECT p.source_id, w.field, c.ordinal, c."column",
           row_number() OVER (PARTITION BY p.source_id, w.field ORDER BY c.ordinal) AS rn
    FROM presets p
    JOIN (SELECT preset, field, signature_column FROM sigs
          UNION ALL SELECT DISTINCT preset, 'currency', 'currency' FROM sigs) w ON w.preset = p.preset
    JOIN catalog c ON c.source_id = p.source_id AND lower(trim(c."column")) = w.signature_column) x
  WHERE rn = 1)"""


@register("detect_preset", _PRESET_SQL + "\nSELECT source_id, preset FROM presets")
def q_detect_preset(spark, sf_dir):
    """M8: billing source recognised from each header."""
    return MP.detect_preset(_catalog(spark, sf_dir))


@register("preset_mapping", _PRESET_SQL + "\nSELECT source_id, field, ordinal, \"column\" FROM pmap")
def q_preset_mapping(spark, sf_dir):
    """M9: the mapping a detected preset implies."""
    cat = _catalog(spark, sf_dir)
    return MP.preset_mapping(cat, MP.detect_preset(cat))


@register("unmapped_fields", _greedy_sql() + """
SELECT l.source_id, f.field FROM (SELECT DISTINCT source_id FROM catalog) l, (VALUES ('amount'), ('status'), ('customer_id'), ('date')) f(field)
WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.source_id = l.source_id AND m.field = f.field)""")
def q_unmapped_fields(spark, sf_dir):
    """M5: required fields the fuzzy mapping leaves open, for every source."""
    cat = _catalog(spark, sf_dir)
    return MP.unmapped_fields(MP.auto_map_columns(cat), cat.select("source_id").distinct())


@register("duplicate_mappings", _SCORE_SQL + """,
best AS (SELECT source_id, field, "column" FROM (
  SELECT n.*, row_number() OVER (PARTITION BY source_id, field ORDER BY exact DESC, score DESC, ordinal) AS rn
  FROM scores n WHERE exact OR score >= 50) x WHERE rn = 1)
SELECT source_id, "column", count(*) AS n_fields, list_sort(list(field)) AS fields FROM best
GROUP BY source_id, "column" HAVING count(*) > 1""")
def q_duplicate_mappings(spark, sf_dir):
    """M6: columns picked for two fields when each field takes its most similar column on its own."""
    return MP.duplicate_mappings(MP.best_columns(_catalog(spark, sf_dir), threshold=50))


@register("apply_mapping", "WITH " + _UP_SQL + """
SELECT tenant_id, id_text AS customer_id, day AS date, amount_text AS amount, spelled AS status, currency,
       CASE layout WHEN 'custom' THEN 'Created By,' ELSE '' END || 'order_ref,line_no,memo' AS passed
FROM cells WHERE NOT too_long""")
def q_apply_mapping(spark, sf_dir):
    """M7: rows with the canonical names, and the names of the columns that pass through."""
    passed = F.array_join(F.transform("extras", lambda e: e["name"]), ",")
    return _ingested(spark, sf_dir).select("tenant_id", *CL.CANONICAL, passed.alias("passed"))


# Cleaning on the billing facts.

_RAW_DEDUP = "WITH " + O.FACTS


@register("dedup", _RAW_DEDUP + """
SELECT tenant_id, customer_id, date, round(amount, 6) AS amount, status, currency FROM subs""")
def q_dedup(spark, sf_dir):
    """Exact duplicates removed (typed values)."""
    raw = billing_rows(spark, sf_dir)
    d = CL.normalize(CL.dedup(CL.typed(raw)))
    return round_doubles(d.select("tenant_id", *CL.CANONICAL))


@register("normalize_status", _RAW_DEDUP + """
SELECT tenant_id,
       CASE status WHEN 'active' THEN 'Active' WHEN 'churned' THEN 'cancelled' ELSE 'Payment Failed' END AS raw_status,
       status, count(*) AS n_rows FROM raw GROUP BY ALL""")
def q_normalize_status(spark, sf_dir):
    """Raw spellings and their canonical status, with row counts."""
    raw = billing_rows(spark, sf_dir)
    return (raw.select("tenant_id", F.col("status").alias("raw_status"),
                       FCOL.normalize_status(F.col("status")).alias("status"))
               .groupBy("tenant_id", "raw_status", "status").agg(F.count(F.lit(1)).alias("n_rows")))


@register("currency_conflicts", _RAW_DEDUP + """
SELECT tenant_id, count(DISTINCT currency) AS n_currencies, list_sort(list(DISTINCT currency)) AS currencies
FROM subs WHERE currency IS NOT NULL GROUP BY tenant_id HAVING count(DISTINCT currency) > 1""")
def q_currency_conflicts(spark, sf_dir):
    """Tenants blocked for mixing currencies."""
    return CL.currency_conflicts(subscriptions(spark, sf_dir))


@register("currency_label", _RAW_DEDUP + """
SELECT tenant_id, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) ELSE 'N/A' END AS currency_label
FROM subs GROUP BY tenant_id""")
def q_currency_label(spark, sf_dir):
    """The tenant's single currency or N/A."""
    return CL.currency_label(subscriptions(spark, sf_dir))


@register("row_cap", _RAW_DEDUP + """
SELECT tenant_id, src_order, src_line FROM (
  SELECT tenant_id, src_order, src_line,
         row_number() OVER (PARTITION BY tenant_id ORDER BY src_order, src_line) AS rn FROM raw) x
WHERE rn <= 1000""")
def q_row_cap(spark, sf_dir):
    """The free plan's first 1,000 rows per tenant in export order."""
    return CL.row_cap(billing_rows(spark, sf_dir), "free").select("tenant_id", "src_order", "src_line")


@register("cleaning_report", _RAW_DEDUP + """
SELECT r.tenant_id, r.n AS rows_before, r.n - d.n AS duplicates_removed, d.zeros AS zeros_count,
       d.negs AS negatives_count, d.n AS rows_after, false AS encoding_warning, d.ncur > 1 AS multicurrency_error
FROM (SELECT tenant_id, count(*) AS n FROM raw GROUP BY tenant_id) r
JOIN (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE amount = 0) AS zeros,
             count(*) FILTER (WHERE amount < 0) AS negs, count(DISTINCT currency) AS ncur
      FROM subs GROUP BY tenant_id) d ON d.tenant_id = r.tenant_id""")
def q_cleaning_report(spark, sf_dir):
    """Cleaning counters per tenant (a by-product of the rollup pass)."""
    return CL.cleaning_report_from_history(rollup_of(spark, sf_dir).hist)


@register("paying_rows", _RAW_DEDUP + """
SELECT tenant_id, customer_id, date, round(amount, 6) AS amount FROM subs WHERE status = 'active' AND amount > 0""")
def q_paying_rows(spark, sf_dir):
    """C11: the rows that count toward MRR."""
    return round_doubles(CL.paying_rows(subscriptions(spark, sf_dir)).select("tenant_id", "customer_id", "date", "amount"))


@register("preview", _RAW_DEDUP + """
SELECT tenant_id, src_order, src_line, row_no FROM (
  SELECT tenant_id, src_order, src_line,
         row_number() OVER (PARTITION BY tenant_id ORDER BY src_order, src_line) AS row_no FROM raw) x
WHERE row_no <= 10""")
def q_preview(spark, sf_dir):
    """The first 10 rows of each tenant's export."""
    return CL.preview(billing_rows(spark, sf_dir), 10).select("tenant_id", "src_order", "src_line", "row_no")


# --- streaming forms (T1, T2 on a stream) ----------------------------------------

#: The stream's files hold events in no order over the whole log, so the watermark lies a log's length behind.
STREAM_FILES, STREAM_DELAY = 12, "60 days"


def _event_files(spark, sf_dir) -> str:
    """The event log as files in no order of time, written once per input; a stream reads a few per micro-batch."""
    from recurra.session import shared_path
    ident = table_files(spark, sf_dir, "events")
    path = shared_path(spark, "event-files-" + hashlib.sha1(repr(ident).encode()).hexdigest()[:12])
    if not CX._exists(spark, f"{path}/_SUCCESS"):
        tables.read_table(spark, sf_dir, "events").repartition(STREAM_FILES, F.xxhash64("event_id")).write.mode("overwrite").parquet(path)
    return path


def _events_stream_run(spark, sf_dir, which: str, build):
    import datetime as _dt

    from recurra.streaming import sessions_stream as SS
    marker = {"event_id": -1, "ts": _dt.datetime.fromisoformat(SS.END_MARKER_TS), "user_id": SS.END_MARKER_USER,
              "event_type": "end", "value": 0.0, "props": None}
    path = _event_files(spark, sf_dir)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    out = SS.run_to_parquet(spark, build, path, SS.EVENT_SCHEMA, marker, f"sessions-{which}", max_bytes=str(size // 4))
    return out.where(F.col("user_id") != SS.END_MARKER_USER).select(
        "user_id", "session_start", "session_end", "n_events")


_SESS_STREAM_SQL = """WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pt FROM e),
m AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 1800000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session_idx FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
FROM m GROUP BY user_id, session_idx"""


@register("sessions_idle_stream", _SESS_STREAM_SQL)
def q_sessions_idle_stream(spark, sf_dir):
    """T1 as Structured Streaming (session_window + watermark, append)."""
    from recurra.streaming import sessions_stream as SS
    return _events_stream_run(spark, sf_dir, "idle", lambda e: SS.idle_sessions_stream(e, watermark=STREAM_DELAY))


@register("sessions_max_age_stream", _SESS_STREAM_SQL)
def q_sessions_max_age_stream(spark, sf_dir):
    """T1 + T2 as Structured Streaming (keyed state, several micro-batches of unordered files).
    The 8-hour rule does not fire on this event log, so the oracle is T1's."""
    from recurra.streaming import sessions_stream as SS
    return _events_stream_run(spark, sf_dir, "max_age", lambda e: SS.sessions_stream(e, watermark=STREAM_DELAY))


@register("sessions_max_age_slow_stream", _max_age_sql(SLOW_IDLE, SLOW_MAX_AGE).replace(_SESS_OUT, """SELECT user_id, min(ts) AS session_start,
       max(ts) AS session_end, count(*) AS n_events"""))
def q_sessions_max_age_slow_stream(spark, sf_dir):
    """T1 + T2 as Structured Streaming with limits of a day and three days, under which the age rule fires."""
    from recurra.streaming import sessions_stream as SS
    return _events_stream_run(spark, sf_dir, "max_age_slow", lambda e: SS.sessions_stream(e, SLOW_IDLE, SLOW_MAX_AGE, STREAM_DELAY))


@register("customer_month_stream", "WITH " + O.FACTS + f"""
SELECT tenant_id, {O.label('pidx')} AS period, round(CAST(mrr AS DOUBLE), 6) AS mrr, n AS active FROM tm""")
def q_customer_month_stream(spark, sf_dir):
    """A5/S2 on a stream: facts come in several micro-batches into a store that a replayed batch does not change."""
    from recurra.session import shared_path
    from recurra.streaming import rollup_stream as RS
    import uuid
    base = shared_path(spark, f"fact-files-{uuid.uuid4().hex[:8]}")
    raw = billing_rows(spark, sf_dir)
    # Copies of a row agree in all columns, so they lie in one file.
    raw.repartition(STREAM_FILES, *raw.columns).write.parquet(f"{base}/in")
    store = RS.run(spark, f"{base}/in", raw.schema, f"{base}/store", files_per_batch=3)
    return round_doubles(RS.monthly(RS.merged(spark, store)))


# --- customer-level sets behind the metrics (G3, G6, K3) and the sales feed (R8) --

_SETS_SQL = "WITH " + O.LAST + """,
lastidx AS (SELECT tenant_id, pidx, arpu FROM bym2 b
            WHERE pidx = (SELECT max(pidx) FROM bym2 x WHERE x.tenant_id = b.tenant_id))"""


@register("new_customers", _SETS_SQL + """
SELECT f.tenant_id, f.customer_id FROM first_seen f JOIN lastidx l ON l.tenant_id = f.tenant_id AND l.pidx = f.fs""")
def q_new_customers(spark, sf_dir):
    """First-ever appearance in the tenant's last month."""
    return MX.new_customers(rollup_of(spark, sf_dir))


@register("new_customers_by_month", "WITH " + O.BY_MONTH + f"""
SELECT f.tenant_id, f.customer_id, {O.label('f.fs')} AS period FROM first_seen f JOIN tm t ON t.tenant_id = f.tenant_id AND t.pidx = f.fs""")
def q_new_customers_by_month(spark, sf_dir):
    """G3 for every paying month as if it were the last."""
    return MX.new_customers_by_month(rollup_of(spark, sf_dir))


@register("reactivated_customers", _SETS_SQL + """
SELECT p.tenant_id, p.customer_id, round(CAST(p.amt AS DOUBLE), 6) AS mrr
FROM pay p JOIN lastidx l ON l.tenant_id = p.tenant_id AND l.pidx = p.pidx
WHERE (p.pidx - (SELECT max(q.pidx) FROM pay q WHERE q.tenant_id = p.tenant_id AND q.customer_id = p.customer_id
                  AND q.pidx < p.pidx) - 1) BETWEEN 2 AND 9
  AND NOT (l.arpu > 0 AND (SELECT max(x.mx) FROM maxrow x WHERE x.tenant_id = p.tenant_id
                           AND x.customer_id = p.customer_id AND (x.pidx IS NULL OR x.pidx <= p.pidx)) > 6 * l.arpu)""")
def q_reactivated_customers(spark, sf_dir):
    """Customers back after a 2-9 month absence (annual plans excluded)."""
    return round_doubles(MX.reactivated_customers(rollup_of(spark, sf_dir)))


@register("churn_type", _SETS_SQL + """
SELECT s.tenant_id, s.customer_id, CASE WHEN s.has_churned THEN 'voluntary' ELSE 'involuntary' END AS churn_type
FROM status_at s JOIN lastidx l ON l.tenant_id = s.tenant_id AND l.pidx = s.pidx
WHERE s.has_churned OR s.has_past_due""")
def q_churn_type(spark, sf_dir):
    """K3: voluntary / involuntary churn sets of the last month."""
    return MX.churn_type(rollup_of(spark, sf_dir))


@register("sales_json", _PLAN_SQL + """
SELECT email, product_id, refunded, chargedback FROM sales""")
def q_sales_json(spark, sf_dir):
    """The order feed landed as JSON sale lists and read back with
    from_json + explode (one list per order, no grouping)."""
    landed = _sales(spark, sf_dir).select(
        "email", F.to_json(F.array(F.struct("product_id", "refunded", "chargedback"))).alias("sales_json"))
    return PL.sales_from_json(landed).select("email", "product_id", "refunded", "chargedback")
