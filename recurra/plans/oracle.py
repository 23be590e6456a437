"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans, as plain set-based SQL over the
driver tables (lineitem, orders, customer, events, documents, ...). Every
double output is rounded to 6 decimals, as the Spark side does.
"""

from __future__ import annotations

from recurra.sources.tables import RAW_BILLING_SQL

# Clean facts: dedup on whole rows, tenants that mix currencies left out of all metrics, month ordinal, money decimal.
FACTS = RAW_BILLING_SQL + """,
subs AS (SELECT DISTINCT * FROM raw),
blocked AS (SELECT tenant_id FROM subs WHERE currency IS NOT NULL GROUP BY tenant_id HAVING count(DISTINCT currency) > 1),
s AS (SELECT *, CAST(year(date) * 12 + month(date) - 1 AS INTEGER) AS pidx,
             CAST(amount AS DECIMAL(18,4)) AS amt FROM subs
      WHERE tenant_id NOT IN (SELECT tenant_id FROM blocked)),
pay AS (SELECT tenant_id, customer_id, pidx, sum(amt) AS amt
        FROM s WHERE status = 'active' AND amount > 0 AND pidx IS NOT NULL
        GROUP BY tenant_id, customer_id, pidx),
tm AS (SELECT tenant_id, pidx, sum(amt) AS mrr, count(*) AS n FROM pay GROUP BY tenant_id, pidx)"""


def label(expr: str) -> str:
    return f"printf('%04d-%02d', CAST(floor(({expr}) / 12) AS INTEGER), CAST((({expr}) % 12) + 1 AS INTEGER))"


# Metrics evaluated at month M = tm.pidx for every month with paying rows.
# Each block names the month under evaluation m.pidx and its prev m.pidx-1.
BY_MONTH = FACTS + f""",
first_seen AS (SELECT tenant_id, customer_id, min(pidx) AS fs FROM s GROUP BY tenant_id, customer_id),
maxrow AS (SELECT tenant_id, customer_id, pidx, max(amount) AS mx FROM s
           WHERE status = 'active' AND amount > 0 GROUP BY tenant_id, customer_id, pidx),
months AS (
  SELECT t.tenant_id, t.pidx, t.mrr, t.n,
         CAST(t.mrr AS DOUBLE) / t.n AS arpu,
         p.mrr AS prev_mrr, p.n AS prev_n,
         (SELECT count(*) FROM tm e WHERE e.tenant_id = t.tenant_id AND e.pidx < t.pidx) AS n_earlier
  FROM tm t LEFT JOIN tm p ON p.tenant_id = t.tenant_id AND p.pidx = t.pidx - 1),
lastset AS (SELECT p.*, m.arpu FROM pay p JOIN months m ON p.tenant_id = m.tenant_id AND p.pidx = m.pidx),
prevset AS (SELECT p.tenant_id, p.customer_id, p.pidx + 1 AS m, p.amt FROM pay p),
status_at AS (SELECT tenant_id, customer_id, pidx,
                     bool_or(status = 'active') AS has_active,
                     bool_or(status = 'churned') AS has_churned,
                     bool_or(status = 'past_due') AS has_past_due
              FROM s WHERE pidx IS NOT NULL GROUP BY tenant_id, customer_id, pidx),
react AS (
  SELECT l.tenant_id, l.pidx, count(*) AS n_react, sum(l.amt) AS react_mrr
  FROM lastset l
  WHERE (l.pidx - (SELECT max(q.pidx) FROM pay q WHERE q.tenant_id = l.tenant_id
                    AND q.customer_id = l.customer_id AND q.pidx < l.pidx) - 1) BETWEEN 2 AND 9
    AND NOT (l.arpu > 0 AND (SELECT max(x.mx) FROM maxrow x WHERE x.tenant_id = l.tenant_id
                             AND x.customer_id = l.customer_id
                             AND (x.pidx IS NULL OR x.pidx <= l.pidx)) > 6 * l.arpu)
  GROUP BY l.tenant_id, l.pidx),
newc AS (
  SELECT f.tenant_id, f.fs AS pidx, count(*) AS n_new,
         sum(coalesce(l.amt, 0)) AS new_mrr
  FROM first_seen f LEFT JOIN pay l ON l.tenant_id = f.tenant_id AND l.customer_id = f.customer_id AND l.pidx = f.fs
  WHERE f.fs IS NOT NULL GROUP BY f.tenant_id, f.fs),
prevstats AS (
  SELECT pv.tenant_id, pv.m AS pidx,
         count(*) FILTER (WHERE l.customer_id IS NULL) AS n_lost,
         count(*) FILTER (WHERE l.customer_id IS NOT NULL) AS n_existing,
         count(*) FILTER (WHERE coalesce(st.has_churned, false)) AS n_vol,
         count(*) FILTER (WHERE coalesce(st.has_past_due, false) AND NOT coalesce(st.has_churned, false)) AS n_invol,
         sum(CASE WHEN NOT coalesce(st.has_active, false) THEN pv.amt ELSE 0 END) AS churn_a,
         sum(CASE WHEN l.customer_id IS NOT NULL AND l.amt > pv.amt THEN l.amt - pv.amt ELSE 0 END) AS expansion
  FROM prevset pv
  LEFT JOIN pay l ON l.tenant_id = pv.tenant_id AND l.customer_id = pv.customer_id AND l.pidx = pv.m
  LEFT JOIN status_at st ON st.tenant_id = pv.tenant_id AND st.customer_id = pv.customer_id AND st.pidx = pv.m
  GROUP BY pv.tenant_id, pv.m),
refund_b AS (
  SELECT r.tenant_id, r.pidx, sum(-r.amt) AS refund_b
  FROM s r
  WHERE r.amount < 0 AND r.pidx IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM prevset pv WHERE pv.tenant_id = r.tenant_id AND pv.customer_id = r.customer_id
                    AND pv.m = r.pidx
                    AND NOT EXISTS (SELECT 1 FROM s a WHERE a.tenant_id = r.tenant_id AND a.customer_id = r.customer_id
                                    AND a.pidx = r.pidx AND a.status = 'active'))
  GROUP BY r.tenant_id, r.pidx),
active_cnt AS (SELECT tenant_id, pidx, count(DISTINCT customer_id) AS n_active FROM s
               WHERE status = 'active' AND pidx IS NOT NULL GROUP BY tenant_id, pidx),
pos_month AS (SELECT tenant_id, pidx, sum(amt) AS pos FROM s WHERE amount > 0 GROUP BY tenant_id, pidx),
undated AS (SELECT tenant_id, sum(pos) AS pos FROM pos_month WHERE pidx IS NULL GROUP BY tenant_id),
core AS (
  SELECT m.tenant_id, m.pidx,
         CAST(m.mrr AS DOUBLE) AS mrr, m.arpu, m.n,
         CASE WHEN m.prev_n IS NOT NULL THEN 'ok' WHEN m.n_earlier > 0 THEN 'gap' ELSE 'missing' END AS st,
         CAST(m.prev_mrr AS DOUBLE) AS prev_mrr, m.prev_n,
         CAST((SELECT sum(pm.pos) FROM pos_month pm WHERE pm.tenant_id = m.tenant_id AND pm.pidx <= m.pidx)
              + coalesce((SELECT u.pos FROM undated u WHERE u.tenant_id = m.tenant_id), 0) AS DOUBLE) AS total_revenue,
         coalesce(CAST(nc.new_mrr AS DOUBLE), 0.0) AS new_mrr, coalesce(nc.n_new, 0) AS n_new,
         coalesce(CAST(rc.react_mrr AS DOUBLE), 0.0) AS react_mrr, coalesce(rc.n_react, 0) AS n_react,
         ps.n_lost, ps.n_existing, ps.n_vol, ps.n_invol,
         CAST(coalesce(ps.churn_a, 0) + coalesce(rb.refund_b, 0) AS DOUBLE) AS rev_churn_ok,
         CAST(ps.expansion AS DOUBLE) AS expansion,
         coalesce(ac.n_active, 0) AS n_active
  FROM months m
  LEFT JOIN newc nc ON nc.tenant_id = m.tenant_id AND nc.pidx = m.pidx
  LEFT JOIN react rc ON rc.tenant_id = m.tenant_id AND rc.pidx = m.pidx
  LEFT JOIN prevstats ps ON ps.tenant_id = m.tenant_id AND ps.pidx = m.pidx
  LEFT JOIN refund_b rb ON rb.tenant_id = m.tenant_id AND rb.pidx = m.pidx
  LEFT JOIN active_cnt ac ON ac.tenant_id = m.tenant_id AND ac.pidx = m.pidx),
bym AS (
  SELECT tenant_id, pidx, {label('pidx')} AS period, mrr, mrr * 12 AS arr, arpu, total_revenue,
         new_mrr, react_mrr AS reactivation_mrr,
         CASE WHEN st = 'ok' AND prev_mrr <> 0 THEN (mrr - prev_mrr) / prev_mrr * 100 END AS growth_rate,
         CAST(n_new AS BIGINT) AS new_subscribers, CAST(n_react AS BIGINT) AS reactivated_subscribers,
         CASE WHEN st = 'ok' THEN n_lost / prev_n * 100 END AS churn_rate,
         CASE WHEN st = 'ok' THEN n_vol / prev_n * 100 END AS voluntary_churn_rate,
         CASE WHEN st = 'ok' THEN n_invol / prev_n * 100 END AS involuntary_churn_rate,
         CASE WHEN st = 'ok' THEN rev_churn_ok ELSE 0.0 END AS revenue_churn,
         CASE WHEN st = 'ok' AND prev_mrr <> 0 THEN least(greatest((mrr - rev_churn_ok) / prev_mrr * 100, 0.0), 999.0) END AS nrr,
         CAST(n_active AS BIGINT) AS active_subscribers,
         CASE WHEN st = 'ok' THEN CAST(n_lost AS BIGINT) END AS lost_subscribers,
         CASE WHEN st = 'ok' THEN CAST(n_existing AS BIGINT) ELSE CAST(0 AS BIGINT) END AS existing_subscribers,
         CASE WHEN st = 'ok' THEN prev_mrr END AS mrr_prev_month,
         CASE WHEN st = 'ok' THEN CAST(prev_n AS BIGINT) END AS active_subscribers_prev_month,
         CASE WHEN st = 'ok' THEN expansion END AS expansion_mrr,
         n < 5 AS last_month_is_fallback, st AS prev_month_status, CAST(n AS BIGINT) AS paying_customers
  FROM core),
bym2 AS (
  SELECT *, coalesce(nrr > 200, false) AS nrr_warning,
         CASE WHEN churn_rate IS NULL OR churn_rate = 0 THEN arpu * 36 ELSE arpu / (churn_rate / 100) END AS ltv
  FROM bym)"""

METRIC_COLUMNS = [
    "mrr", "arr", "arpu", "total_revenue",
    "new_mrr", "reactivation_mrr", "growth_rate", "new_subscribers", "reactivated_subscribers",
    "churn_rate", "voluntary_churn_rate", "involuntary_churn_rate", "revenue_churn", "nrr",
    "nrr_warning", "ltv", "active_subscribers", "lost_subscribers", "existing_subscribers",
    "mrr_prev_month", "active_subscribers_prev_month", "expansion_mrr",
]
DOUBLE_METRICS = {"mrr", "arr", "arpu", "total_revenue", "new_mrr", "reactivation_mrr", "growth_rate",
                  "churn_rate", "voluntary_churn_rate", "involuntary_churn_rate", "revenue_churn", "nrr",
                  "ltv", "mrr_prev_month", "expansion_mrr"}


def r6(col: str) -> str:
    return f"round({col}, 6) AS {col}" if col in DOUBLE_METRICS else col


# Last-month slice per tenant; tenants without paying rows get empty values.
LAST = BY_MONTH + f""",
tenants AS (SELECT tenant_id, CAST(sum(CASE WHEN amount > 0 THEN amt ELSE 0 END) AS DOUBLE) AS total_all
            FROM s GROUP BY tenant_id),
lastm AS (SELECT b.* FROM bym2 b WHERE b.pidx = (SELECT max(pidx) FROM bym2 x WHERE x.tenant_id = b.tenant_id)),
metrics_last AS (
  SELECT t.tenant_id, l.period AS last_month,
         coalesce(l.mrr, 0.0) AS mrr, coalesce(l.arr, 0.0) AS arr, coalesce(l.arpu, 0.0) AS arpu,
         t.total_all AS total_revenue, coalesce(l.new_mrr, 0.0) AS new_mrr,
         coalesce(l.reactivation_mrr, 0.0) AS reactivation_mrr, l.growth_rate,
         coalesce(l.new_subscribers, 0) AS new_subscribers,
         coalesce(l.reactivated_subscribers, 0) AS reactivated_subscribers,
         l.churn_rate, l.voluntary_churn_rate, l.involuntary_churn_rate,
         coalesce(l.revenue_churn, 0.0) AS revenue_churn, l.nrr,
         coalesce(l.nrr_warning, false) AS nrr_warning, coalesce(l.ltv, 0.0) AS ltv,
         coalesce(l.active_subscribers, 0) AS active_subscribers, l.lost_subscribers,
         coalesce(l.existing_subscribers, 0) AS existing_subscribers,
         l.mrr_prev_month, l.active_subscribers_prev_month, l.expansion_mrr,
         coalesce(l.last_month_is_fallback, true) AS last_month_is_fallback,
         {label('l.pidx - 1')} AS prev_month,
         coalesce(l.prev_month_status, 'missing') AS prev_month_status
  FROM tenants t LEFT JOIN lastm l ON l.tenant_id = t.tenant_id)"""


def last_metric_sql(cols: list[str]) -> str:
    sel = ", ".join(["tenant_id", "last_month"] + [r6(c) for c in cols])
    return f"WITH {LAST}\nSELECT {sel} FROM metrics_last"


def by_month_sql(cols: list[str]) -> str:
    sel = ", ".join(["tenant_id", "period"] + [r6(c) for c in cols])
    return f"WITH {BY_MONTH}\nSELECT {sel} FROM bym2"
