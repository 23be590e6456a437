"""Cleaning (C*), schema resolution (M*) and privacy/name helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F


def raw_frame(spark, rows):
    return spark.createDataFrame(
        [("t1", *r) for r in rows],
        "tenant_id string, customer_id string, date string, amount string, status string, currency string")


def test_status_normalisation(spark):
    from recurra.functions.columns import normalize_status
    vals = ["Active", "ACTIVE", "Churned", "CHURNED", "Trial", "TRIAL", " Past Due ", "Payment Failed",
            "CANCELED", "paused", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(normalize_status(F.col("s"))).collect()]
    assert got == ["active", "active", "churned", "churned", "trial", "trial", "past_due", "past_due",
                   "canceled", "paused", None]


def test_clean_counts_and_typed_dedup(spark):
    from recurra.operators import clean as CL
    rows = [("A", "2024-01-01", "49", "active", "USD"), ("A", "2024-01-01", "49.00", "active", "USD"),
            ("B", "2024-01-01", "0", "active", "USD"), ("C", "2024-01-01", "-5", "active", "USD"),
            ("D", "2024-01-01", "-7", "churned", "USD")]
    rep = CL.cleaning_report(raw_frame(spark, rows)).collect()[0]
    assert rep["rows_before"] == 5 and rep["rows_after"] == 4
    assert rep["duplicates_removed"] == 1
    assert rep["zeros_count"] == 1 and rep["negatives_count"] == 2
    assert rep["multicurrency_error"] is False
    subs = CL.clean(raw_frame(spark, rows))
    assert subs.count() == 4
    assert subs.where("amount <= 0").count() == 3  # zero and negative rows are kept


def test_dedup_before_normalisation(spark):
    from recurra.operators import clean as CL
    rows = [("A", "2024-01-01", "10", "active", "USD"), ("A", "2024-01-01", "10", "Active", "USD")]
    assert CL.clean(raw_frame(spark, rows)).count() == 2


def test_mixed_currency(spark):
    from recurra.operators import clean as CL
    rows = [("A", "2024-01-01", "10", "active", "USD"), ("B", "2024-01-01", "10", "active", "EUR"),
            ("C", "2024-01-01", "10", "active", None)]
    subs = CL.clean(raw_frame(spark, rows))
    conflicts = CL.currency_conflicts(subs).collect()
    assert len(conflicts) == 1 and conflicts[0]["currencies"] == ["EUR", "USD"]
    assert CL.without_conflicts(subs).count() == 0
    assert CL.currency_label(subs).collect()[0]["currency_label"] == "N/A"


def test_row_cap_and_preview_order(spark):
    from recurra.operators import clean as CL
    rows = [("t1", i // 3, i % 3) for i in range(40)] + [("t2", i, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "tenant_id string, src_order long, src_line long")
    top = CL.top_n_per_group(df, ["tenant_id"], ["src_order", "src_line"], F.lit(7), salt_buckets=4)
    got = sorted((r["tenant_id"], r["src_order"], r["src_line"]) for r in top.collect())
    want = sorted([("t1", i // 3, i % 3) for i in range(7)] + [("t2", i, 0) for i in range(5)])
    assert got == want


@pytest.mark.parametrize("name,expected", [
    ("  Customer ID ", "customer_id"), ("Billing-Date", "billing_date"), ("amount.usd", "amount_usd"),
    ("__Plan  Status__", "plan_status"), ("Prix (€)", "prix"), ("a--b..c", "a_b_c"),
])
def test_sanitize(spark, name, expected):
    from recurra.operators.mapping import sanitize
    df = spark.createDataFrame([(name,)], "c string")
    assert df.select(sanitize(F.col("c"))).first()[0] == expected


def test_indel_ratio_matches_definition(spark):
    from recurra.operators.mapping import indel_ratio, lcs_length
    pairs = [("subscription_status", "subscription_id"), ("curr", "currency"), ("ccy", "currency"),
             ("", ""), ("abc", ""), ("created", "created_at")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(lcs_length(F.col("a"), F.col("b")), indel_ratio(F.col("a"), F.col("b"))).collect()

    def lcs(a, b):
        prev = [0] * (len(b) + 1)
        for ca in a:
            cur = [0]
            for j, cb in enumerate(b, 1):
                cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
            prev = cur
        return prev[-1]
    for (a, b), (l, r) in zip(pairs, got):
        assert l == lcs(a, b)
        assert r == pytest.approx(100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b)))
    assert got[0][1] == pytest.approx(76.47, abs=0.01)


def _map(spark, cols):
    from recurra.operators import mapping as M
    cat = M.catalog_from_columns(spark, {"s": cols})
    return {r["field"]: r["column"] for r in M.auto_map_columns(cat).collect()}


def test_auto_map_synonyms_and_order(spark):
    assert _map(spark, ["subscription_status", "subscription_id", "amount", "date"]) == {
        "status": "subscription_status", "customer_id": "subscription_id", "amount": "amount", "date": "date"}
    m = _map(spark, ["Client ID", "Billing Date", "Plan Amount", "Subscription Status", "Currency Code"])
    assert m == {"customer_id": "Client ID", "date": "Billing Date", "amount": "Plan Amount",
                 "status": "Subscription Status", "currency": "Currency Code"}


def test_auto_map_blocklist_and_one_to_one(spark):
    m = _map(spark, ["created_by", "customer", "price", "state", "created_at"])
    assert "created_by" not in m.values()
    assert m["customer_id"] == "customer" and m["amount"] == "price" and m["date"] == "created_at"
    assert len(set(m.values())) == len(m)


def test_auto_map_exact_beats_earlier_fuzzy(spark):
    m = _map(spark, ["amounts", "amount"])
    assert m["amount"] == "amount"


def test_unmapped_and_duplicates(spark):
    from recurra.operators import mapping as M
    cat = M.catalog_from_columns(spark, {"s": ["foo", "amount"]})
    mp = M.auto_map_columns(cat)
    missing = sorted(r["field"] for r in M.unmapped_fields(mp, cat.select("source_id").distinct()).collect())
    assert missing == ["customer_id", "date", "status"]
    dup = spark.createDataFrame([("s", "amount", "x"), ("s", "status", "x")], "source_id string, field string, column string")
    assert M.duplicate_mappings(dup).count() == 1


@pytest.mark.parametrize("cols,preset", [
    (["customer_id", "created", "amount", "status"], "stripe"),
    (["customer_id", "created_at", "amount", "status"], "paddle"),
    (["email", "created_at", "price", "cancelled"], "gumroad"),
    (["Customer_Email", "Created_At", "Total", "Status"], "lemonsqueezy"),
    (["customer_id", "started_at", "amount", "status"], "chargebee"),
    (["customer_id", "date", "amount", "status"], "manual"),
    (["customer_id", "created", "created_at", "amount", "status"], "stripe"),
    (["customer_id", "amount", "status"], None),
])
def test_detect_preset(spark, cols, preset):
    from recurra.operators import mapping as M
    cat = M.catalog_from_columns(spark, {"s": cols})
    got = M.detect_preset(cat).collect()
    assert (got[0]["preset"] if got else None) == preset


def test_preset_mapping_keeps_original_spelling(spark):
    from recurra.operators import mapping as M
    cat = M.catalog_from_columns(spark, {"s": ["Customer_Email", "Created_At", "Total", "Status", "Currency"]})
    pm = {r["field"]: r["column"] for r in M.preset_mapping(cat, M.detect_preset(cat)).collect()}
    assert pm == {"customer_id": "Customer_Email", "date": "Created_At", "amount": "Total", "status": "Status",
                  "currency": "Currency"}


def test_apply_mapping(spark):
    from recurra.operators import mapping as M
    df = spark.createDataFrame([("1", "x", "5", "keep")], "cid string, amount string, amt string, extra string")
    out = M.apply_mapping(df, {"cid": "customer_id", "amt": "amount"})
    assert sorted(out.columns) == ["amount", "customer_id", "extra"]
    assert out.first()["amount"] == "5"


def test_pii_scrub(spark):
    from recurra.operators.privacy import scrub_pii
    cases = [
        ("mail bob.smith+x@example.co.uk now", "mail [EMAIL REDACTED] now"),
        ("Authorization: Bearer abc.DEF-123_x", "Authorization: Bearer [TOKEN REDACTED]"),
        ('{"access_token": "zzz"}', '{"token": "[REDACTED]"}'),
        ("key sk_live_ABCDEFGHIJKLMNOPQRSTUV end", "key [KEY REDACTED] end"),
        ("short_key_123 stays", "short_key_123 stays"),
        ("from 192.168.0.1:80", "from [IP REDACTED]:80"),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r[0] for r in df.select(scrub_pii(F.col("t"))).collect()]
    assert got == [b for _, b in cases]


def test_scrub_nested(spark):
    from recurra.operators.privacy import scrub_array, scrub_map
    df = spark.createDataFrame([({"a": "x@y.io", "b": "ok"}, ["1.2.3.4", "fine"])], "m map<string,string>, l array<string>")
    r = df.select(scrub_map(F.col("m")).alias("m"), scrub_array(F.col("l")).alias("l")).first()
    assert r["m"] == {"a": "[EMAIL REDACTED]", "b": "ok"}
    assert r["l"] == ["[IP REDACTED]", "fine"]


@pytest.mark.parametrize("name,expected", [
    ("My Report 2024!", "my_report_2024"), ("Ünïcode — Name", "ünïcode_name"), ("!!!", "report"),
    ("a - b", "a_b"), ("x__y", "x__y"),
])
def test_safe_name(spark, name, expected):
    from recurra.operators.privacy import safe_name
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(safe_name(F.col("n"))).first()[0] == expected


def test_cleaning_report_from_rollup_equals_direct(spark):
    from recurra.operators import clean as CL
    from recurra.operators import metrics as MX
    rows = [("A", "2024-01-01", "49", "active", "USD"), ("A", "2024-01-01", "49.00", "active", "USD"),
            ("A", "2024-01-01", "49", "active", "USD"), ("B", "2024-02-01", "0", "active", "USD"),
            ("C", "bad date", "-5", "active", "USD"), ("C", "bad date", "-5", "active", "USD"),
            ("D", "2024-02-03", "-7", "churned", "EUR"), ("E", "2024-02-03", "x", "trial", None)]
    raw = raw_frame(spark, rows)
    direct = {k: v for k, v in CL.cleaning_report(raw).first().asDict().items()}
    via = {k: v for k, v in CL.cleaning_report_from_history(MX.Rollup(CL.clean(raw)).hist).first().asDict().items()}
    assert direct == via
    assert via["rows_before"] == 8 and via["duplicates_removed"] == 3 and via["multicurrency_error"] is True


def test_lcs_by_bits_is_the_table(spark):
    """Against the row-by-row table, on words over few letters, empty ones and the longest synonym's length."""
    import random
    from recurra.operators import mapping as MP
    r = random.Random(2)
    words = ["", "a"] + ["".join(r.choices("ab_c", k=r.randrange(1, 40))) for _ in range(40)]
    for synonym in ("a", "ab_c", "subscription_amount", "c" * 62):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        got = df.select(MP.lcs_by_bits(F.col("w"), MP.synonym_masks(synonym), F.lit(len(synonym))).alias("x"),
                        MP.lcs_length(F.col("w"), F.lit(synonym)).alias("y")).collect()
        assert all(x == y for x, y in got)
