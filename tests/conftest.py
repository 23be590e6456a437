from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from recurra.session import get_spark
    s = get_spark("local[4]", 4, app_name="recurra-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def subs_of(spark):
    """Build a clean subscriptions table from (customer, date, amount, status[, currency]) tuples."""
    from recurra.operators import clean as CL

    def make(rows, tenant="t1"):
        data = []
        for r in rows:
            cur = r[4] if len(r) > 4 else "USD"
            data.append((tenant, str(r[0]), None if r[1] is None else str(r[1]),
                         None if r[2] is None else str(r[2]), r[3], cur))
        raw = spark.createDataFrame(
            data, "tenant_id string, customer_id string, date string, amount string, status string, currency string")
        return CL.clean(raw)
    return make


@pytest.fixture(scope="session")
def metrics_of(subs_of):
    from recurra.operators import metrics as MX

    def run(rows, tenant="t1"):
        m = MX.metrics_last(MX.Rollup(subs_of(rows, tenant)))
        out = {r["tenant_id"]: r.asDict() for r in m.collect()}
        return out[tenant]
    return run


def months(year: int, first: int, last: int):
    return [f"{year}-{m:02d}-15" for m in range(first, last + 1)]
