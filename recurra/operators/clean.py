"""Cleaning and set-level quality operators.

All operators are per tenant (one tenant = one billing export in the
reference). Nothing is collected: reports are grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions import columns as C
from recurra.functions.constants import PLAN_ROW_CAPS
from recurra.session import materialize

CANONICAL = ["customer_id", "date", "amount", "status", "currency"]


def _typed_amount(df: DataFrame) -> Column:
    if isinstance(df.schema["amount"].dataType, T.StringType):
        return C.parse_amount_expr("amount")
    return F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double"))


def file_facts(raw: DataFrame) -> DataFrame:
    """Per file of an ingested upload: its number in the tenant (by path), the date format that its first date decides, and whether all its amounts are numbers."""
    dated = F.when(F.col("date").isNotNull(), F.col("ordinal"))
    number = F.col("amount").isNull() | C.parse_amount_expr("amount").isNotNull()
    # The first date's place, and then the date: a text among what is grouped would have all rows sorted, and spilled.
    found = raw.groupBy("tenant_id", F.col("file").alias("_file")).agg(F.min(dated).alias("_at"), F.bool_and(number).alias("_numeric"))
    # Stored, so that its size is known (one row a file) and the rows need not be shuffled by file to meet it.
    found = materialize(raw.sparkSession, found.withColumn("_no", F.row_number().over(Window.partitionBy("tenant_id").orderBy("_file"))), "file-places")
    first = raw.join(found, (F.col("file") == F.col("_file")) & (F.col("ordinal") == F.col("_at"))).groupBy("_file").agg(F.min("date").alias("_first"))
    return materialize(raw.sparkSession, found.join(first, "_file", "left").select("_file", "_no", C.date_format_of(F.col("_first")).alias("_format"), "_numeric"), "file-facts")


def ingested(df: DataFrame) -> bool:
    """Whether the rows know their place in a file."""
    return {"file", "ordinal"} <= set(df.columns)


def typed(df: DataFrame) -> DataFrame:
    """Cast amount/date to their types (C4, C5; NaN -> NULL, bad -> NULL).

    One date format holds per file: rows of an upload take the format of the
    file's first date, values in any other spelling are NULL. Rows without a
    place in a file are read by tenant: if any slash date can only be read with
    the day first, all of them are. Either is one grouped aggregate.
    """
    amount = _typed_amount(df)
    if not isinstance(df.schema["date"].dataType, T.StringType):
        return df.withColumns({"amount": amount, "date": F.col("date").cast("timestamp_ntz")})
    if ingested(df):
        met = df.join(file_facts(df), F.col("file") == F.col("_file"))
        return met.withColumns({"amount": amount, "date": C.parse_date_as("date", F.col("_format"))}).drop("_file", "_no", "_format", "_numeric")
    order = df.groupBy("tenant_id").agg(F.bool_or(C.only_day_first("date")).alias("_day_first"))
    order = order.where("_day_first").withColumnRenamed("tenant_id", "_tenant")
    met = df.join(order, F.col("tenant_id").eqNullSafe(F.col("_tenant")), "left")
    day_first = F.coalesce("_day_first", F.lit(False))
    return met.withColumns({"amount": amount, "date": C.parse_date_expr("date", day_first)}).drop("_day_first", "_tenant")


def _as_written(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of an upload with what decides whether they are copies: the amount as a number, its text where their file has others, the file's date format."""
    met = raw.join(facts, F.col("file") == F.col("_file")).drop("_file")
    return met.withColumns({"_text": F.when(~F.col("_numeric"), F.col("amount")), "_written": F.col("amount"), "amount": _typed_amount(raw)}).drop("_numeric")


def distinct_rows(raw: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """C1 with types: each distinct row once, with its multiplicity ``n_copies`` and its ``first`` copy (place, date and amount as written).

    Two rows are copies only if they agree in all columns of the export, before
    any normalisation. Rows of an upload are compared as they were written: dates
    as text, amounts as numbers if all amounts of their file are numbers. The
    grouping hashes whole rows, so one hot customer is spread over many tasks,
    and copies are counted map-side first. ``facts`` are the ``file_facts`` of the
    whole upload, needed if ``raw`` has only some of its rows.
    """
    if not ingested(raw):
        t = typed(raw)
        return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n_copies"))
    met = _as_written(raw, file_facts(raw) if facts is None else facts)
    keys = [c for c in met.columns if c not in ("file", "ordinal", "_written", "_no")]
    # The place is a file's number, not its path, which would be shuffled with every row; the date as written is a key.
    first = F.min(F.struct("_no", "ordinal", F.col("_written").alias("amount")))
    d = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"), first.alias("first"))
    d = d.withColumn("first", F.struct(F.col("first._no").alias("file_no"), "first.ordinal", "date", "first.amount"))
    return d.withColumn("date", C.parse_date_as("date", F.col("_format"))).drop("_format", "_text")


def dedup(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Exact-duplicate removal on the typed values of all columns (NULLs compare equal).

    Expressed as a grouping so duplicates are combined map-side before the
    shuffle; the key includes date and amount, so one hot customer is spread
    over many tasks.
    """
    return df.dropDuplicates(keys)


def clean_status() -> Column:
    """C2 on the column ``status``: a missing status becomes the text 'nan'."""
    return F.coalesce(C.normalize_status(F.col("status")), F.lit("nan"))


def normalize(df: DataFrame) -> DataFrame:
    """Canonical status and trimmed text customer id."""
    out = df.withColumn("status", clean_status())
    return out.withColumn("customer_id", C.text_key(F.col("customer_id")))


def _with_currency(raw: DataFrame) -> DataFrame:
    return raw if "currency" in raw.columns else raw.withColumn("currency", F.lit(None).cast("string"))


def _canonical(distinct: DataFrame, customer: Column) -> DataFrame:
    return distinct.select(
        "tenant_id", customer.alias("customer_id"), "date", "amount",
        clean_status().alias("status"), "currency", "n_copies",
        C.period_idx(F.col("date")).alias("period_idx"),
        C.period_label(C.period_idx(F.col("date"))).alias("period"))


def clean(raw: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The clean ``subscriptions`` table.

    Zero and negative amounts are kept; NULL dates stay (they only drop out
    of month-grouped metrics).
    """
    # The grouping keeps each distinct row's multiplicity (n_copies), so the
    # cleaning report is a by-product of this pass. The customer-month rollup
    # that follows pre-aggregates map-side again, so its own exchange carries at
    # most one row per customer-month and task.
    return _canonical(distinct_rows(_with_currency(raw), facts), C.text_key(F.col("customer_id")))


#: Rows of one partition by customer from which its customers' rows are dealt out as whole rows instead.
HEAVY_ROWS = 1_000_000


def clean_by_customer(raw: DataFrame) -> list[DataFrame]:
    """``clean`` of an upload in parts that share no customer, for what groups by customer afterwards.

    Rows are shuffled once, by (tenant, customer): copies have the same customer, and months and customers are grouped
    behind it without a further shuffle. Customers of partitions that would get more than ``HEAVY_ROWS`` rows, as one
    hot customer's, are a part of their own, left to ``clean``, which spreads them.
    """
    raw, facts = _with_currency(raw), file_facts(raw)
    keyed = raw.withColumn("_who", C.text_key(F.col("customer_id")))
    # The number of the partition that the shuffle below deals a row to.
    place = F.pmod(F.hash("tenant_id", "_who"), F.lit(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    heavy = [r["place"] for r in keyed.groupBy(place.alias("place")).count().where(F.col("count") > HEAVY_ROWS).collect()]
    light = _as_written(keyed.where(~place.isin(heavy)) if heavy else keyed, facts)
    # The id as written where it is not the stripped one, and other columns as one text: equal for equal rows, and short.
    spelled = F.when(F.col("customer_id").isNull(), F.lit("")).when(F.col("customer_id") != F.col("_who"), F.col("customer_id"))
    light = light.withColumns({"_spelled": spelled, **({"extras": F.to_json("extras")} if "extras" in raw.columns else {})})
    light = light.drop("customer_id", "file", "ordinal", "_no", "_written").repartition("tenant_id", "_who")
    d = light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("n_copies"))
    parts = [_canonical(d.withColumn("date", C.parse_date_as("date", F.col("_format"))), F.col("_who"))]
    return parts + [clean(keyed.where(place.isin(heavy)).drop("_who"), facts)] if heavy else parts


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Per-tenant counters of the cleaning step.

    ``encoding_warning`` (R3) is raised if any file of the tenant was read as latin-1.
    """
    # One pass: distinct rows with their multiplicity, then per tenant.
    warned = F.bool_or("encoding_warning") if "encoding_warning" in raw.columns else F.bool_or(F.lit(False))
    return (distinct_rows(raw).groupBy("tenant_id").agg(
                F.sum("n_copies").alias("rows_before"),
                F.count(F.lit(1)).alias("rows_after"),
                F.count_if(F.col("amount") == 0).alias("zeros_count"),
                F.count_if(F.col("amount") < 0).alias("negatives_count"),
                F.count_distinct("currency").alias("_ncur"), warned.alias("encoding_warning"))
            .select("tenant_id", "rows_before",
                    (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"),
                    "zeros_count", "negatives_count", "rows_after", "encoding_warning",
                    (F.col("_ncur") > 1).alias("multicurrency_error")))


def cleaning_report_from_history(hist: DataFrame) -> DataFrame:
    """C9 from the materialized rollup: the dedup pass kept each distinct
    row's multiplicity and the rollup summed the counters per customer-month
    (undated rows included), so no second pass over the facts is needed."""
    return (hist.groupBy("tenant_id").agg(
                F.sum("n_raw_rows").alias("rows_before"),
                F.sum("n_rows").alias("rows_after"),
                F.sum("n_zero").alias("zeros_count"),
                F.sum("n_negative").alias("negatives_count"),
                F.min("currency_min").alias("_cmin"), F.max("currency_max").alias("_cmax"))
            .select("tenant_id", "rows_before",
                    (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"),
                    "zeros_count", "negatives_count", "rows_after",
                    F.lit(False).alias("encoding_warning"),
                    F.coalesce(F.col("_cmin") != F.col("_cmax"), F.lit(False)).alias("multicurrency_error")))


def blocked_tenants(hist: DataFrame) -> DataFrame:
    """C6 from the customer-month rollup: (tenant_id) of tenants with more than one currency."""
    return (hist.groupBy("tenant_id").agg(F.min("currency_min").alias("a"), F.max("currency_max").alias("b"))
            .where(F.col("a") != F.col("b")).select("tenant_id"))


def currency_conflicts(subs: DataFrame) -> DataFrame:
    """Tenants whose export holds more than one distinct currency."""
    return (subs.where(F.col("currency").isNotNull())
            .groupBy("tenant_id")
            .agg(F.count_distinct("currency").alias("n_currencies"),
                 F.array_sort(F.collect_set("currency")).alias("currencies"))
            .where(F.col("n_currencies") > 1))


def without_conflicts(subs: DataFrame) -> DataFrame:
    """C6 guard: drop the rows of blocked tenants (the reference refuses them)."""
    blocked = currency_conflicts(subs).select("tenant_id")
    return subs.join(blocked, "tenant_id", "left_anti")


def currency_label(subs: DataFrame) -> DataFrame:
    """The single currency, or 'N/A'."""
    return (subs.groupBy("tenant_id")
            .agg(F.count_distinct("currency").alias("n"), F.min("currency").alias("c"))
            .select("tenant_id", F.when(F.col("n") == 1, F.col("c")).otherwise(F.lit("N/A"))
                    .alias("currency_label")))


def row_cap(raw: DataFrame, plan: str | DataFrame = "pro",
            order_cols: tuple[str, ...] = ("src_order", "src_line")) -> DataFrame:
    """Keep the first N rows per tenant in ingest order (before dedup).

    ``plan`` is a plan name or a (tenant_id, plan) table. The rank is a
    per-tenant window; the cap is the feature, not a sampling shortcut.
    """
    caps = F.create_map(*[x for k, v in PLAN_ROW_CAPS.items() for x in (F.lit(k), F.lit(v))])
    if isinstance(plan, str):
        with_plan = raw.withColumn("_plan", F.lit(plan))
    else:
        with_plan = raw.join(plan.select("tenant_id", F.col("plan").alias("_plan")), "tenant_id", "left")
    with_plan = with_plan.withColumn(
        "_cap", F.coalesce(F.element_at(caps, F.col("_plan")), F.lit(PLAN_ROW_CAPS["free"])))
    return top_n_per_group(with_plan, ["tenant_id"], list(order_cols), F.col("_cap")).drop("_plan", "_cap", "row_no")


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    n: Column, salt_buckets: int = 16) -> DataFrame:
    """Exact first-n rows per group, safe when one group holds most rows.

    Stage 1 ranks inside (group, salt) buckets and keeps at most n per
    bucket, so a hot group is sorted by many tasks; stage 2 ranks the at most
    ``salt_buckets * n`` survivors of each group. Adds ``row_no``.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order_cols]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    stage1 = (df.withColumn("_salt", salt).withColumn("_n", n)
              .withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= F.col("_n")))
    return (stage1.withColumn("row_no", F.row_number().over(w2))
            .where(F.col("row_no") <= F.col("_n"))
            .drop("_salt", "_r1", "_n"))


def paying_rows(subs: DataFrame) -> DataFrame:
    """C11: rows counted in MRR."""
    return subs.where(C.is_paying())


def preview(raw: DataFrame, n: int = 10, order_cols: tuple[str, ...] = ("src_order", "src_line")) -> DataFrame:
    """The first n rows of each tenant's export (top-k per tenant)."""
    return top_n_per_group(raw, ["tenant_id"], list(order_cols), F.lit(n))
