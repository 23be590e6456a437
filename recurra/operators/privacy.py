"""Privacy scrubbing and safe names.

All of it is JVM-side ``regexp_replace`` over whole texts (no prefixes, no
Python per row). The five PII patterns run in the reference's order.
Character classes are Unicode, so a token after ``Bearer`` and a no-break space
is scrubbed too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions.constants import PII_PATTERNS

# Python's str-pattern \s, spelled out so Java and RE2 can use the same set.
PY_SPACE_CODEPOINTS = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                       (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                       (0x3000, 0x3000)]


def _java_cp(c: int) -> str:
    return f"\\x{{{c:X}}}"


PY_SPACE_JAVA = "".join(_java_cp(a) if a == b else f"{_java_cp(a)}-{_java_cp(b)}" for a, b in PY_SPACE_CODEPOINTS)


def _java_pattern(pattern: str) -> str:
    """A pattern with Python's meaning of its classes. Only ``\\d`` and ``\\b`` need the slow Unicode mode."""
    pattern = pattern.replace(r"\s", f"[{PY_SPACE_JAVA}]")
    return ("(?U)" if r"\d" in pattern or r"\b" in pattern else "") + pattern


def scrub_pii(text: Column) -> Column:
    """Apply every pattern in order (email, bearer, token field, key, IPv4)."""
    out = text
    for pattern, replacement in PII_PATTERNS:
        out = F.regexp_replace(out, F.lit(_java_pattern(pattern)), F.lit(replacement.replace("$", "\\$")))
    return out


def scrub_nested(value: Column, kind: T.DataType) -> Column:
    """Scrub every string inside a value of any nested type, however deep; keys and names stay."""
    if isinstance(kind, T.StringType):
        return scrub_pii(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: scrub_nested(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _k, v: scrub_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[scrub_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(scrub_pii(F.to_json(value)))
    return value


def scrub_columns(df: DataFrame, *names: str) -> DataFrame:
    """E3 on whole columns, by their types."""
    return df.withColumns({n: scrub_nested(F.col(n), df.schema[n].dataType) for n in names})


def scrub_json(df: DataFrame, name: str) -> DataFrame:
    """E3 on JSON text of no known schema: one pass finds the common schema, a second one scrubs inside it.

    A field that holds different kinds in different rows stays a variant and is scrubbed as text. Text that is no JSON
    object or array is scrubbed as plain text. The schema has an entry for every key, so keys must not be data.
    """
    parsed = F.try_parse_json(name)
    found = df.select(F.schema_of_variant_agg(parsed)).first()[0]
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found or "VOID")
    if not ddl.startswith(("STRUCT<", "ARRAY<")):
        return df.withColumn(name, scrub_pii(F.col(name)))
    kind = T.DataType.fromDDL(ddl)
    nested = F.to_json(scrub_nested(F.from_json(F.col(name), ddl), kind))
    return df.withColumn(name, F.when(parsed.isNotNull(), nested).otherwise(scrub_pii(F.col(name))))


def scrub_map(m: Column) -> Column:
    """Scrub every string value of a MAP<STRING,STRING>."""
    return F.transform_values(m, lambda _k, v: scrub_pii(v))


def scrub_array(a: Column) -> Column:
    """Scrub every string item of an ARRAY<STRING>."""
    return F.transform(a, lambda v: scrub_pii(v))


def safe_name(name: Column, default: str = "report") -> Column:
    """Keep word characters, whitespace and '-', turn runs of '-' and
    whitespace into '_', lower-case; empty -> ``default``."""
    kept = F.regexp_replace(name, F.lit(f"[^\\p{{L}}\\p{{N}}_{PY_SPACE_JAVA}-]"), F.lit(""))
    joined = F.regexp_replace(kept, F.lit(f"[-{PY_SPACE_JAVA}]+"), F.lit("_"))
    low = F.lower(joined)
    return F.when(low.isNull() | (low == ""), F.lit(default)).otherwise(low)


def scrub_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, scrub_pii(F.col(text_col)))
