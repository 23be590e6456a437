"""Metric snapshots: rows, upsert, history, month-over-month.

A snapshot is one (user_id, period) row of eight headline metrics. Here a
user is a tenant and a snapshot is taken for every month with paying rows
(metrics evaluated as of that month), so the table grows with tenants x
months. The store is parquet partitioned by ``period`` under the shared
checkpoint folder; an upsert rewrites only the touched periods (dynamic
partition overwrite), since MERGE needs a table format not available here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.functions.constants import PERIOD_PATTERN, SNAPSHOT_METRIC_KEYS
from recurra.session import materialize

SERVICE_COLUMNS = ["snapshot_id", "user_id", "created_at", "source"]
SNAPSHOT_COLUMNS = ["snapshot_id", "user_id", "period", *SNAPSHOT_METRIC_KEYS, "source", "created_at"]


def snapshot_id(user: Column, period: Column) -> Column:
    """Deterministic key (the reference uses a random UUID)."""
    return F.md5(F.concat_ws("|", user, period))


def month_close(period: Column) -> Column:
    """Snapshot time: the first instant after the period's month."""
    return F.add_months(F.to_date(F.concat(period, F.lit("-01"))), 1).cast("timestamp")


def snapshot_rows(metrics: DataFrame, source: str = "billing") -> DataFrame:
    """Project the 8 metric keys plus user, period, source."""
    return metrics.select(
        snapshot_id(F.col("tenant_id"), F.col("period")).alias("snapshot_id"),
        F.col("tenant_id").alias("user_id"), "period",
        *[F.col(k).cast("int").alias(k) if k == "active_subscribers" else F.col(k) for k in SNAPSHOT_METRIC_KEYS],
        F.lit(source).alias("source"),
        month_close(F.col("period")).alias("created_at"))


def snapshot_rejects(rows: DataFrame) -> DataFrame:
    """S3: blank user_id, blank period or a period not shaped YYYY-MM."""
    reason = reject_reason()
    return rows.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def reject_reason() -> Column:
    """Why a row's key is invalid, or NULL."""
    blank_user = F.coalesce(F.trim(F.col("user_id")) == "", F.lit(True))
    blank_period = F.coalesce(F.trim(F.col("period")) == "", F.lit(True))
    bad_shape = ~F.coalesce(F.col("period").rlike(PERIOD_PATTERN), F.lit(False))
    return (F.when(blank_user, F.lit("blank_user_id"))
             .when(blank_period, F.lit("blank_period"))
             .when(bad_shape, F.lit("bad_period_format")))


def valid_rows(rows: DataFrame) -> DataFrame:
    """S3: the rows whose key is valid."""
    return rows.where(reject_reason().isNull())


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on (user_id, period).

    Metric keys present in ``incoming`` overwrite (a present NULL overwrites
    too); keys absent from ``incoming`` keep the stored value. New keys are
    inserted. Rows with an invalid key are rejected first; of several incoming
    rows for one key the one taken last (by created_at) counts.
    """
    incoming = valid_rows(incoming)
    last = [F.col("created_at")] if "created_at" in incoming.columns else []
    values = [c for c in incoming.columns if c not in ("user_id", "period")]
    newest = F.max(F.struct(*last, *[c for c in values if c != "created_at"]))
    incoming = incoming.groupBy("user_id", "period").agg(newest.alias("_row")).select("user_id", "period", "_row.*")
    inc_keys = [k for k in SNAPSHOT_METRIC_KEYS if k in incoming.columns]
    inc = incoming.select("user_id", "period", F.lit(True).alias("_hit"),
                          *[F.col(k).alias(f"_in_{k}") for k in inc_keys],
                          *[F.col(c).alias(f"_in_{c}") for c in ("source", "created_at") if c in incoming.columns])
    j = existing.join(inc, ["user_id", "period"], "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = []
    for k in SNAPSHOT_METRIC_KEYS:
        cols.append((F.when(hit, F.col(f"_in_{k}")).otherwise(F.col(k)) if k in inc_keys else F.col(k)).alias(k))
    src = F.col("_in_source") if "source" in incoming.columns else F.lit("")
    created = F.col("_in_created_at") if "created_at" in incoming.columns else F.current_timestamp()
    return j.select(
        F.coalesce(F.col("snapshot_id"), snapshot_id(F.col("user_id"), F.col("period"))).alias("snapshot_id"),
        "user_id", "period", *cols,
        F.when(hit, src).otherwise(F.col("source")).alias("source"),
        F.when(hit, created).otherwise(F.col("created_at")).alias("created_at"))


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Sink: parquet partitioned by period; only the periods that ``rows`` holds are replaced.

    ``rows`` must hold a touched period whole and must not be read from
    ``path`` itself; :func:`upsert_into` takes care of both.
    """
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period").parquet(path))


def read_snapshots(spark, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.select(*[F.col(c).cast("string") if c == "period" else F.col(c) for c in SNAPSHOT_COLUMNS])


def upsert_into(spark, path: str, incoming: DataFrame) -> None:
    """S2 sink: merges ``incoming`` into the store and rewrites the touched periods alone."""
    touched = valid_rows(incoming).select("period").distinct()
    existing = read_snapshots(spark, path).join(touched, "period", "left_semi")
    merged = materialize(spark, upsert(existing, incoming).select(*SNAPSHOT_COLUMNS), "snapshot-upsert")
    write_snapshots(merged, path)


def history(snaps: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's snapshots ordered by period (or all users, by user)."""
    s = snaps if user_id is None else snaps.where(F.col("user_id") == user_id)
    return s.select("user_id", "period", "mrr", "churn_rate", "nrr", "arpu").orderBy("user_id", "period")


def own_rows(snaps: DataFrame, user_id: str) -> DataFrame:
    """Row-level visibility - a user only ever reads their own rows."""
    return snaps.where(F.col("user_id") == F.lit(user_id))


def mom_deltas(snaps: DataFrame) -> DataFrame:
    """Deltas between each user's last two snapshots (users with >= 2).

    MRR as % (NULL when the previous MRR is 0 or NULL), churn and NRR in
    percentage points (NULL when either side is NULL).
    """
    w = Window.partitionBy("user_id").orderBy(F.col("period").desc())
    ranked = (snaps.select("user_id", "period", "mrr", "churn_rate", "nrr")
                   .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2))
    cur = ranked.where(F.col("_rn") == 1)
    prev = ranked.where(F.col("_rn") == 2).select(
        "user_id", F.col("period").alias("previous_period"), F.col("mrr").alias("previous_mrr"),
        F.col("churn_rate").alias("previous_churn_rate"), F.col("nrr").alias("previous_nrr"))
    j = cur.join(prev, "user_id")
    pm = F.col("previous_mrr")
    return j.select(
        "user_id", F.col("period").alias("current_period"), "previous_period",
        F.col("mrr").alias("current_mrr"), "previous_mrr",
        F.when(pm.isNotNull() & (pm != 0), (F.col("mrr") - pm) / pm * 100).alias("mrr_delta_pct"),
        F.col("churn_rate").alias("current_churn_rate"), "previous_churn_rate",
        (F.col("churn_rate") - F.col("previous_churn_rate")).alias("churn_delta_pp"),
        F.col("nrr").alias("current_nrr"), "previous_nrr",
        (F.col("nrr") - F.col("previous_nrr")).alias("nrr_delta_pp"))


def trend(snaps: DataFrame) -> DataFrame:
    """MRR and churn series by period."""
    return snaps.select("user_id", "period", "mrr", "churn_rate").orderBy("user_id", "period")


def table(snaps: DataFrame) -> DataFrame:
    """History table columns."""
    return snaps.select("user_id", "period", "mrr", "arpu", "churn_rate", "nrr").orderBy("user_id", "period")


def csv_columns(snaps: DataFrame) -> list[str]:
    """Period first, the remaining non-service columns alphabetically."""
    rest = sorted(c for c in snaps.columns if c not in SERVICE_COLUMNS and c != "period")
    return ["period", *rest]


def csv_frame(snaps: DataFrame) -> DataFrame:
    return snaps.select(*csv_columns(snaps))


def write_csv(snaps: DataFrame, path: str) -> None:
    """S7 sink for one user: one CSV file ordered by period, header row, NULL as empty field.

    A user has one row per month, so one file is enough; a frame with several
    users is refused (see :func:`write_all_csv`).
    """
    if snaps.select("user_id").distinct().limit(2).count() > 1:
        raise ValueError("write_csv takes the snapshots of one user")
    rows = csv_frame(snaps).repartition(1).sortWithinPartitions("period")
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_all_csv(snaps: DataFrame, path: str) -> None:
    """S7 sink for all users: a folder per user with one ordered file."""
    rows = snaps.select("user_id", *csv_columns(snaps)).repartition("user_id").sortWithinPartitions("user_id", "period")
    (rows.write.mode("overwrite").option("header", True).option("nullValue", "")
         .partitionBy("user_id").csv(path))


def register_visible(spark, snaps: DataFrame) -> str:
    """A table function with the reader as its parameter; returns its name.

    It is the only name under which the rows can be read: the predicate is part of the function's body, and its
    argument a value, so no query over it can leave the predicate out or add to it.
    """
    import uuid
    tag = uuid.uuid4().hex[:12]
    snaps.createOrReplaceTempView(f"snapshots_{tag}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snaps.schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION visible_{tag}(reader STRING) RETURNS TABLE ({columns}) "
              f"RETURN SELECT {', '.join(f'`{c}`' for c in snaps.columns)} FROM snapshots_{tag} WHERE user_id = reader")
    return f"visible_{tag}"


def visible_rows(spark, function: str, user_id: str | None) -> DataFrame:
    """What ``user_id`` may read, by a function of :func:`register_visible`; nothing for a null reader."""
    return spark.sql(f"SELECT * FROM {function}(CAST(:reader AS STRING))", args={"reader": user_id})
