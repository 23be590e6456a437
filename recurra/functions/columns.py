"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from recurra.functions.constants import PANDAS_NA_STRINGS, STATUS_MAP

# Money is summed as a long-backed decimal so totals are exact and do not
# depend on partitioning or summation order.
MONEY = "decimal(28,4)"

# A plain decimal number in text form (rejects '49d', '$5', '1,000').
NUMERIC_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def period_idx(date_col: Column) -> Column:
    """Month ordinal year*12 + month - 1 (NULL for a NULL date)."""
    return (F.year(date_col) * 12 + F.month(date_col) - 1).cast("int")


def period_label(idx_col: Column) -> Column:
    """'yyyy-MM' label of a month ordinal."""
    return F.format_string(
        "%04d-%02d",
        F.floor(idx_col / 12).cast("int"),
        (F.pmod(idx_col, F.lit(12)) + 1).cast("int"),
    )


def label_to_idx(label_col: Column) -> Column:
    """Inverse of :func:`period_label`."""
    return (F.substring(label_col, 1, 4).cast("int") * 12
            + F.substring(label_col, 6, 2).cast("int") - 1)


def money(col: Column) -> Column:
    return col.try_cast(MONEY)


def strip(col: Column) -> Column:
    """Text without Unicode white space at both ends (tabs, newlines, no-break spaces)."""
    space = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
    return F.regexp_replace(col.cast("string"), f"^{space}|{space}$", "")


def normalize_status(raw: Column) -> Column:
    """strip, then exact-key map to the canonical status, else lower()."""
    stripped = strip(raw)
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_MAP.items())])
    return F.coalesce(F.element_at(mapping, stripped), F.lower(stripped))


def null_if_na_string(col: Column) -> Column:
    """pandas reads its default NA spellings as missing; Spark keeps them."""
    return F.when(col.isin(PANDAS_NA_STRINGS), F.lit(None)).otherwise(col)


def text_key(col: Column) -> Column:
    """astype(str).strip(): a missing value becomes the literal 'nan'."""
    return F.coalesce(strip(col), F.lit("nan"))


def parse_amount_expr(col_name: str) -> Column:
    """Same as :func:`parse_amount` for a named column (uses SQL try_cast)."""
    s = F.col(col_name).cast("string")
    return F.nanvl(
        F.when(s.rlike(NUMERIC_TEXT), F.expr(f"try_cast(trim(cast(`{col_name}` as string)) as double)")),
        F.lit(None).cast("double"),
    )


def only_day_first(col_name: str) -> Column:
    """Whether a slash date can only be read with the day first."""
    day = F.regexp_extract(F.col(col_name).cast("string"), r"^\s*(\d{1,2})/\d{1,2}/\d{4}", 1)
    return F.coalesce(F.when(day != "", day.cast("int") > 12), F.lit(False))


def parse_date_expr(col_name: str, day_first: Column | None = None) -> Column:
    """to_datetime(errors='coerce'): ISO forms, then slash forms with the month first, or the day where ``day_first``."""
    s = f"trim(cast(`{col_name}` as string))"
    iso = F.expr(f"coalesce(try_to_timestamp({s}), try_to_timestamp({s}, 'yyyy-MM'), try_to_timestamp({s}, 'yyyy/MM/dd'))")
    month = F.expr(f"try_to_timestamp({s}, 'M/d/yyyy')")
    if day_first is None:
        return F.coalesce(iso, month).cast("timestamp_ntz")
    day = F.expr(f"try_to_timestamp({s}, 'd/M/yyyy')")
    return F.coalesce(iso, F.when(day_first, day).otherwise(month)).cast("timestamp_ntz")


def is_paying(status: Column | None = None, amount: Column | None = None) -> Column:
    """The reference's base predicate: status 'active' and amount > 0."""
    status = F.col("status") if status is None else status
    amount = F.col("amount") if amount is None else amount
    return (status == "active") & (amount > 0)


# Date spellings that decide the format of a file: the first value's shape, and the format its other values must have.
# The day comes first only where the first value has no other reading.
_DAY_FIRST = r"(1[3-9]|2[0-9]|3[01])"
DATE_SHAPES = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}", "yyyy-M-d H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy-M-d H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}", "yyyy-M-d'T'H:mm:ss"),
    (r"\d{4}-\d{1,2}", "yyyy-M"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
    (_DAY_FIRST + r"/\d{1,2}/\d{4}", "d/M/yyyy"),
    (_DAY_FIRST + r"\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (_DAY_FIRST + r"-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "M.d.yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    (r"\d{1,2}-[A-Z][a-z]{2}-\d{4}", "d-MMM-yyyy"),
]


def date_format_of(first: Column) -> Column:
    """The format that the first date of a file decides, NULL if its shape is not known."""
    out = None
    for shape, fmt in DATE_SHAPES:
        hit = first.rlike(rf"\A{shape}\z")
        out = F.when(hit, fmt) if out is None else out.when(hit, fmt)
    return out


def parse_date_as(col_name: str, fmt: Column) -> Column:
    """Text in exactly the given format, else NULL; without a format each value is read on its own."""
    # Each format is a constant: one that comes from a column makes a new parser for every row.
    exact = F.lit(None).cast("timestamp")
    for known in dict.fromkeys(f for _, f in DATE_SHAPES):
        exact = F.when(fmt == known, F.try_to_timestamp(F.col(col_name), F.lit(known))).otherwise(exact)
    return F.when(fmt.isNull(), parse_date_expr(col_name).cast("timestamp")).otherwise(exact).cast("timestamp_ntz")
