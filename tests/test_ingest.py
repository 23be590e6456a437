"""CSV uploads (R1-R4, M7) and cleaning rules per export (C2, C4, C6), on hand-written files."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def folder():
    root = tempfile.mkdtemp(prefix="recurra-test-up-", dir="/tmp")

    def put(tenant: str, data: bytes, name: str = "part-0.csv") -> str:
        d = os.path.join(root, "charset=x", f"tenant_id={tenant}", "chunk=0")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
        return root
    return put


HEAD = b"customer_id,date,amount,status,currency\n"


def rows_of(spark, path, **kw):
    from recurra.sources import csv_exports as CX
    return CX.ingest(spark, path, **kw)


def test_short_lines_are_padded_and_long_ones_dropped(spark, folder):
    path = folder("a", HEAD + b'"Acme, Inc, Ltd",2024-01-02,49,active\nB,2024-01-02,49,active,USD,x\n\n"say ""hi""",,5,NA,null\n')
    got = sorted(r["customer_id"] for r in rows_of(spark, path).collect())
    assert got == ["Acme, Inc, Ltd", 'say "hi"']
    r = rows_of(spark, path).where(F.col("customer_id") == 'say "hi"').first()
    assert r["date"] is None and r["status"] is None and r["currency"] is None and r["amount"] == "5"
    assert rows_of(spark, path, strict=True).count() == 0


def test_each_file_has_its_own_header(spark, folder):
    folder("a", HEAD + b"A,2024-01-02,1,active,USD\n")
    path = folder("b", b"note,date,customer_id,amount,status\nx,2024-02-03,B,2,active\n")
    got = {r["customer_id"]: (r["tenant_id"], r["date"], [(e["name"], e["value"]) for e in r["extras"]])
           for r in rows_of(spark, path).collect()}
    assert got == {"A": ("a", "2024-01-02", []), "B": ("b", "2024-02-03", [("note", "x")])}


def test_encodings(spark, folder):
    from recurra.sources import csv_exports as CX
    line = "Ж,2024-01-02,1,active,USD\n"
    folder("utf", HEAD + line.encode())
    folder("bom", b"\xef\xbb\xbf" + HEAD + line.encode())
    folder("cyr", HEAD + line.encode("cp1251"))
    path = folder("lat", HEAD + b"\xe9\x98,2024-01-02,1,active,USD\n")
    up = CX.Uploads(spark, path)
    enc = {r["t"]: (r["encoding"], r["encoding_warning"]) for r in up.encodings().select(
        CX.upload_of(F.col("file"))[0].alias("t"), "encoding", "encoding_warning").collect()}
    assert enc == {"utf": ("utf-8", False), "bom": ("utf-8-sig", False), "cyr": ("cp1251", False), "lat": ("latin-1", True)}
    got = {r["tenant_id"]: r["customer_id"] for r in rows_of(spark, path).collect()}
    assert got == {"utf": "Ж", "bom": "Ж", "cyr": "Ж", "lat": "é\x98"}


def test_one_date_format_per_export(spark):
    from recurra.operators import clean as CL
    rows = [("d", "03/04/2024"), ("d", "13/04/2024"), ("m", "03/04/2024"), ("m", "04/13/2024"), ("i", "2024-04-03"), ("i", "2024-05")]
    df = spark.createDataFrame([(t, "A", d, "1", "active", "USD") for t, d in rows],
                               "tenant_id string, customer_id string, date string, amount string, status string, currency string")
    got = sorted((r["tenant_id"], r["date"].strftime("%Y-%m-%d")) for r in CL.typed(df).collect())
    assert got == [("d", "2024-04-03"), ("d", "2024-04-13"), ("i", "2024-04-03"), ("i", "2024-05-01"), ("m", "2024-03-04"), ("m", "2024-04-13")]


def test_mixed_currency_tenants_leave_the_metrics(spark):
    from recurra.operators import clean as CL
    from recurra.operators import metrics as MX
    rows = [("x", "A", "2024-01-02", "10", "active", "USD"), ("x", "B", "2024-01-02", "10", "active", "EUR"),
            ("y", "A", "2024-01-02", "7", "active", "EUR"), ("y", "B", "2024-01-02", "1", None, None)]
    raw = spark.createDataFrame(rows, "tenant_id string, customer_id string, date string, amount string, status string, currency string")
    r = MX.Rollup(CL.clean(raw))
    assert [(m["tenant_id"], m["mrr"]) for m in MX.metrics_last(r).collect()] == [("y", 7.0)]
    report = {m["tenant_id"]: m["multicurrency_error"] for m in CL.cleaning_report_from_history(r.hist).collect()}
    assert report == {"x": True, "y": False}
    assert CL.clean(raw).where("status = 'nan'").count() == 1


def test_feedback_without_id_is_still_judged(spark):
    from recurra.operators import plan as PL
    fb = spark.createDataFrame([(None, "u", 9, "x"), (None, "u", None, "\t"), (None, "u", None, "\tok\n")],
                               "feedback_id long, user_email string, rating int, message string")
    assert [r["message"] for r in PL.feedback_accepted(fb).collect()] == ["ok"]


def as_pandas_reads(data: bytes):
    import io

    import pandas as pd
    df = pd.read_csv(io.BytesIO(data), dtype=str)
    return sorted(tuple(None if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False))


def test_line_breaks_within_quotes(spark, folder):
    data = HEAD + b'c1,2024-01-02,10,active,"two\nlines"\n"a\r\n""b""\n\n,c",2024-01-02,1,active,USD\r\n5" pipe,2024-01-02,1,act"ive,x"y\nd,2024-01-02,1,active,"\n"\n'
    path = folder("a", b"\n \t\n\r\n" + data)
    got = rows_of(spark, path)
    fields = ("customer_id", "date", "amount", "status", "currency")
    assert sorted(tuple(r[f] for f in fields) for r in got.collect()) == as_pandas_reads(data) and got.count() == 4


def test_records_across_blocks_as_pandas_reads_them(spark, folder):
    """Files of random fields, read in blocks of a few bytes."""
    import random
    r = random.Random(11)
    want = []
    for k in range(6):
        bits = ["a", "b", '"', "\n", "\r\n", "\r", ",", " ", "é", '""', "x" * 30]

        def field():
            text = "".join(r.choice(bits) for _ in range(r.randrange(6)))
            if r.random() < 0.3:
                text = "".join(c for c in text if c not in '\n\r,')
                return "s" + text  # a quote within a field that does not begin with one is a letter
            return '"' + text.replace('"', '""') + '"'
        brk = r.choice(["\n", "\r\n", "\r"])
        lines = [("\n \t\n" if brk == "\n" else brk) * (k % 3) + "customer_id,date,amount,status,currency"]
        lines += [",".join([f"id{i}"] + [field() for _ in range(r.choice([2, 4, 4, 4]))]) + brk * r.choice([0, 0, 1]) for i in range(20)]
        data = (brk.join(lines) + r.choice(["", brk])).encode()
        path = folder(f"t{k}", data)
        want += [(f"t{k}", *row) for row in as_pandas_reads(data)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "199")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        fields = ("tenant_id", "customer_id", "date", "amount", "status", "currency")
        got = [tuple(x[f] for f in fields) for x in rows_of(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
        spark.conf.unset("spark.sql.files.openCostInBytes")

    def order(rows):
        return sorted(rows, key=lambda t: tuple((v is None, v or "") for v in t))
    assert order(got) == order(want)


def test_reading_uploads_shuffles_no_rows(spark, folder):
    from recurra.sources import csv_exports as CX
    folder("a", HEAD + b'A,2024-01-02,1,active,"U\nSD"\n')
    up = CX.Uploads(spark, folder("b", b"note," + HEAD + b'x,B,2024-01-02,1,active,USD\n'))
    rows = up.rows()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r["cells"]) for r in rows.collect()) == [("A", "2024-01-02", "1", "active", "U\nSD"), ("x", "B", "2024-01-02", "1", "active", "USD")]


def test_refused_files(spark, folder):
    from recurra.sources import csv_exports as CX
    folder("ok", HEAD + b"A,2024-01-02,1,active,USD\n")
    folder("open", HEAD + b'A,2024-01-02,1,active,"USD\nB,2024-01-02,1,active,USD\n')
    folder("head", b"\n" + HEAD)
    folder("blank", b" \n\n")
    folder("none", b"")
    path = folder("note", HEAD, "a.txt")
    up = CX.Uploads(spark, path)
    tenant = CX.upload_of(F.col("file"))[0]
    assert {r[0]: r[1] for r in up.rejects().select(tenant, "reject_reason").collect()} == {"open": "unclosed_quote", "head": "no_rows", "blank": "no_columns"}
    assert [r["customer_id"] for r in CX.ingest(spark, path, uploads=up).collect()] == ["A"]
    reasons = {r[0]: r[1] for r in CX.file_manifest(spark, path).select(CX.upload_of(F.col("path"))[0], "reject_reason").collect()}
    assert {k: v for k, v in reasons.items() if v} == {"none": "empty", "note": "not_csv"}


def test_copies_are_judged_before_normalising(spark, folder):
    from recurra.operators import clean as CL
    body = b"A,2024-01-02,49,Active,USD\n" * 3 + b"A,2024-01-02,49.0,Active,USD\nA,2024-01-02,49,active,USD\n A ,2024-01-02,49,Active,USD\n"
    folder("num", HEAD + body)  # all amounts are numbers: 49 and 49.0 are equal
    path = folder("txt", HEAD + body + b"A,2024-01-02,$5,Active,USD\nA,2024-01-02,49d,Active,USD\n")
    d = CL.distinct_rows(rows_of(spark, path))
    got = {}
    for r in d.collect():
        got.setdefault(r["tenant_id"], []).append(r["n_copies"])
    assert {k: sorted(v) for k, v in got.items()} == {"num": [1, 1, 4], "txt": [1, 1, 1, 1, 1, 3]}
    report = {r["tenant_id"]: (r["rows_before"], r["duplicates_removed"], r["encoding_warning"]) for r in CL.cleaning_report(rows_of(spark, path)).collect()}
    assert report == {"num": (6, 3, False), "txt": (8, 2, False)}
    assert {r["customer_id"] for r in CL.clean(rows_of(spark, path)).collect()} == {"A"}
    assert CL.clean(rows_of(spark, path)).where("amount IS NULL").count() == 2


DATES = [
    ["2024-01-02", "2024-1-3", " 2024-01-04", "2024-01-06 00:00:00", "04/05/2024", None], ["03/04/2024", "13/04/2024", "2024-01-02", "3/4/2024"],
    [None, "13/04/2024", "03/04/2024", "04/13/2024"], ["2024-05", "2024-05-03", "2024-06"], ["x", "2024-01-02"], ["2024-01-02 10:11:12", "2024-01-02"],
    ["13.04.2024", "03.04.2024"], ["Jan 02, 2024", "Feb 3, 2024", "2024-01-02"], ["2-Jan-2024", "13-Feb-2024"]]


def test_the_first_date_decides_the_format(spark, folder):
    import warnings

    import pandas as pd

    from recurra.operators import clean as CL
    want = {}
    for k, dates in enumerate(DATES):
        path = folder(f"t{k}", HEAD + "".join(f'c{i:02},"{d or ""}",1,active,USD\n' for i, d in enumerate(dates)).encode())
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for i, d in enumerate(pd.to_datetime(pd.Series(dates, dtype=object), errors="coerce")):
                want[f"t{k}", f"c{i:02}"] = None if pd.isna(d) else d.to_pydatetime()
    assert {(r["tenant_id"], r["customer_id"]): r["date"] for r in CL.clean(rows_of(spark, path)).collect()} == want


def test_records_are_found_once(spark, folder):
    from recurra.sources import csv_exports as CX
    path = folder("a", HEAD + b'"A, ""x""",2024-01-02,1,active,USD\nB,2024-01-02,2,active,"US""D"\n , ,,,\n\n \t\n"C\r\nD",2024-01-02,3,active\r\nE,1,2,3,4,5\n')
    rows = CX.Uploads(spark, path).rows()
    assert [r["cells"] for r in rows.orderBy("at").collect()] == [
        ['A, "x"', "2024-01-02", "1", "active", "USD"], ["B", "2024-01-02", "2", "active", 'US"D'], [" ", " ", "", "", ""], ["C\r\nD", "2024-01-02", "3", "active"]]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(regexp_extract_all(") == 1


def test_a_file_is_decoded_once_and_stored_only_for_many_readers(spark, folder):
    from recurra.sources import csv_exports as CX
    folder("u", HEAD + 'é,2024-01-02,1,active,"U,Щ"\n'.encode())
    path = folder("c", HEAD + 'Щ,2024-01-02,1,active,"U,Щ"\n'.encode("cp1251"))
    assert "encode(" not in CX.Uploads(spark, path).rows()._jdf.queryExecution().optimizedPlan().toString()
    rows = CX.ingest(spark, path, store=False)
    assert not any("ingested" in f for f in rows.inputFiles())
    assert sorted((r["customer_id"], r["currency"]) for r in rows.collect()) == [("é", "U,Щ"), ("Щ", "U,Щ")]


def test_copies_know_their_file_by_number(spark, folder):
    from recurra.operators import clean as CL
    folder("t", HEAD + b"A,2024-01-02,49.0,Active,USD\n", "a.csv")
    path = folder("t", HEAD + b"A,2024-01-02,49,Active,USD\nB,2024-01-02,1,Active,USD\n", "b.csv")
    got = {(r["customer_id"], r["n_copies"]): r["first"].asDict() for r in CL.distinct_rows(rows_of(spark, path)).collect()}
    assert {k: (v["file_no"], v["date"], v["amount"]) for k, v in got.items()} == {
        ("A", 2): (1, "2024-01-02", "49.0"), ("B", 1): (2, "2024-01-02", "1")}


def test_exports_hold_the_lines_of_each_record_in_order(spark, tmp_path):
    from recurra.sources import csv_exports as CX
    raw = spark.range(4000).selectExpr(
        "'MACHINERY' AS tenant_id", "string(id) AS customer_id", "timestamp_ntz'2024-01-02' AS date", "1.0D AS amount", "'Active' AS status", "'USD' AS currency",
        "(id * 37) % 4000 + (id % 2) * 100000 AS src_order", "int(3) AS src_line")
    assert CX.export_records(raw.withColumn("chunk", F.lit(0))).count() == 4000
    CX.write_exports(spark, raw, str(tmp_path / "x"))
    for chunk in (0, 1):
        (file,) = (tmp_path / "x").glob(f"charset=UTF-8/tenant_id=MACHINERY/chunk={chunk}/part-*.csv")
        lines = file.read_bytes().decode().splitlines()
        assert lines[:3] == [" \t", "  ", ",".join(CX.LAYOUTS["custom"].values())]
        starts = [int(x.split(",")[6]) for x in lines[3::4]]
        assert len(starts) == 2000 and starts == sorted(starts) and set(lines[6::4]) == {'end"'}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


# The same customers under other spellings, copies of several kinds, and names and values that only look alike.
ODD_FILES = {
    "a.csv": HEAD.strip() + b",ref,memo\n" + b"".join([
        b"A,2024-01-02,49,Active,USD,1,x\n" * 3, b"A,2024-01-02,49.0,Active,USD,1,x\n", b" A ,2024-01-02,49,Active,USD,1,x\n", b"A,2024-01-02,49,active,USD,1,x\n",
        b'A,2024-01-02,49,Active,USD,1,""\n', b"A,2024-01-02,49,Active,USD,1,NA\n", b'A,2024-01-02,49,Active,USD,1,"x"",""y"\n', b"A,2024-1-2,49,Active,USD,1,x\n",
        b",2024-02-02,5,Active,USD,2,x\n", b"' ',2024-02-02,5,Active,USD,2,x\n", b'" ",2024-02-02,5,Active,USD,2,x\n', b"nan ,2024-02-02,5,Active,USD,2,x\n",
        b"B,03/04/2024,-7,Payment Failed,,3,x\n", b"C,2024-03-02,0,,USD,4,x\n", b"C,2024-03-02,1e2,Active,USD,4,x\n", b"D,,1,Active,USD,5,x\n"]),
    # Other names, the same names in another order, an own date format, an amount that is no number.
    "b.csv": b"memo,ref," + HEAD + b"x,1,A,2024-01-02,49,Active,USD\nx,1,A,2024-01-02,49,Active,USD\n",
    "c.csv": HEAD.strip() + b",memo,ref\n" + b"A,03/04/2024,49,Active,USD,x,1\nA,2024-01-02,$9,Active,USD,x,1\nA,03/04/2024,49.0,Active,USD,x,1\n" + b"E,04/05/2024,1,Active,EUR,,\n" * 4,
    "d.csv": HEAD + b"A,2024-01-02,49,Active,USD\nA,2024-01-02,49,Active,USD,long\n",
}


@pytest.mark.parametrize("heavy", [10**6, 18, 0])
def test_a_customers_rows_are_shuffled_once(spark, folder, monkeypatch, heavy):
    from recurra.operators import clean as CL
    from recurra.operators import metrics as MX
    for tenant in ("t", "u"):
        for name, data in ODD_FILES.items():
            path = folder(tenant, data if tenant == "t" else data.replace(b"EUR", b"USD"), name)
    rows = rows_of(spark, path)
    monkeypatch.setattr(CL, "HEAVY_ROWS", heavy)
    parts = CL.clean_by_customer(rows)
    assert len(parts) == (1 if heavy == 10**6 else 2)

    def sorted_rows(df):
        return sorted(map(str, df.select(sorted(df.columns)).collect()))
    whole, by_customer = MX.Rollup(CL.clean(rows)), MX.Rollup(parts)
    assert sorted_rows(by_customer.subs) == sorted_rows(whole.subs)
    assert sum(r["n_copies"] for r in by_customer.subs.collect()) == rows.count()
    assert sorted_rows(by_customer.hist) == sorted_rows(whole.hist)
    assert sorted_rows(MX.metrics_last(by_customer)) == sorted_rows(MX.metrics_last(whole))
    if len(parts) == 1:
        plan = by_customer.hist._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1


def test_facts_of_files_sort_no_rows(spark, folder, monkeypatch):
    from recurra.operators import clean as CL
    stored = {}

    def keep(spark, df, name):
        stored[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(spark, df, name)
    real = CL.materialize
    monkeypatch.setattr(CL, "materialize", keep)
    folder("t", HEAD + b"A,,x,Active,USD\nA,13/02/2024,1,Active,USD\nA,02/03/2024,1,Active,USD\n", "a.csv")
    path = folder("t", HEAD + b"A,,1,Active,USD\n", "b.csv")
    facts = CL.file_facts(rows_of(spark, path))
    assert sorted((r["_no"], r["_format"], r["_numeric"]) for r in facts.collect()) == [(1, "d/M/yyyy", False), (2, None, True)]
    # What reads every row; the sorts that are left are of one row a file.
    assert "SortAggregate" not in stored["file-places"] and "BroadcastHashJoin" in stored["file-facts"]


def test_the_metrics_of_uploads_shuffle_a_customers_rows_once(spark, folder, monkeypatch):
    from recurra.operators import metrics as MX
    from recurra.plans import catalog
    path = folder("t", HEAD + b"A,2024-01-02,49,Active,USD\nA,2024-02-02,49,Active,USD\n")
    made = []

    def rollup(subs, materialize=False):
        made.append(real(subs))
        return made[0]
    real = MX.Rollup
    monkeypatch.setattr(MX, "Rollup", rollup)
    monkeypatch.setattr(catalog, "_ingested", lambda spark, sf_dir: rows_of(spark, path))
    assert [(r["tenant_id"], r["last_month"], r["mrr"], r["prev_month_status"]) for r in catalog.q_ingest_metrics(spark, path).collect()] == [("t", "2024-02", 49.0, "ok")]
    assert made[0].hist._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
