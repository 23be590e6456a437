"""Schema resolution over a column catalog (M1-M9).

The catalog is a DataFrame ``(source_id, ordinal, column)`` with one row per
header column of each ingested export, so all sources are mapped in one
batch. Synonyms, blocklist and preset signatures are attached to catalog rows
as literal arrays and exploded (generated rows, no join with a data table).
The fuzzy score is the Indel ratio ``200 * LCS / (len1 + len2)``, computed by
a JVM-side dynamic-programming fold (``aggregate`` over characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions.constants import (
    BLOCKLIST, FIELD_ORDER, FIELD_SYNONYMS, FUZZY_THRESHOLD, PRESET_SIGNATURES, REQUIRED_FIELDS)
from recurra.session import materialize

PY_SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def catalog_from_columns(spark: SparkSession, sources: dict[str, list[str]]) -> DataFrame:
    rows = [(s, i, c) for s, cols in sources.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "source_id string, ordinal int, column string")


def sanitize(col: Column) -> Column:
    """M1: strip, lower, [whitespace - .]+ -> '_', drop [^a-z0-9_], collapse
    '_', trim '_'."""
    s = F.regexp_replace(F.lower(col), F.lit(f"^[{PY_SPACE}]+|[{PY_SPACE}]+$"), F.lit(""))
    s = F.regexp_replace(s, F.lit(f"[{PY_SPACE}\\-.]+"), F.lit("_"))
    s = F.regexp_replace(s, F.lit("[^a-z0-9_]"), F.lit(""))
    s = F.regexp_replace(s, F.lit("_+"), F.lit("_"))
    return F.regexp_replace(s, F.lit("^_+|_+$"), F.lit(""))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence length: a fold over the characters of a
    whose state is the previous DP row (length(b) + 1 cells)."""
    fold = F.aggregate(
        F.split(a, ""),
        F.array_repeat(F.lit(0), F.length(b) + 1),
        lambda prev, ca: F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda cur, j: F.concat(cur, F.array(
                F.when(ca == F.substring(b, j, 1), F.element_at(prev, j) + 1)
                 .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j)))))),
        lambda row: F.element_at(row, F.length(b) + 1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(fold)


def synonym_masks(synonym: str) -> Column:
    """For each letter of a synonym the bits of its places."""
    bits: dict[str, int] = {}
    for i, c in enumerate(synonym):
        bits[c] = bits.get(c, 0) | 1 << i
    return F.create_map(*[x for c, b in bits.items() for x in (F.lit(c), F.lit(b).cast("long"))])


def lcs_by_bits(a: Column, masks: Column, size: Column) -> Column:
    """Longest common subsequence with a word of at most 62 letters, given by its masks: one step on a whole row of the
    table per letter of a, held as the bits of a long (a cleared bit is a place where the row rises)."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def step(v: Column, c: Column) -> Column:
        both = v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long")))
        return (v + both).bitwiseOR(v - both).bitwiseAND(full)
    return size - F.bit_count(F.aggregate(F.split(a, ""), full, step))


def indel_ratio(a: Column, b: Column) -> Column:
    """Indel similarity in [0, 100] (two empty strings -> 100)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def sanitized_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("sanitized", sanitize(F.col("column")))


def name_match_scores(catalog: DataFrame) -> DataFrame:
    """M2/M3: best fuzzy score of every non-blocklisted column per field,
    plus the exact-synonym flag."""
    syn = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(FIELD_ORDER.index(f)).alias("field_rank"),
                             F.lit(s).alias("synonym"), F.lit(len(s)).alias("size"), synonym_masks(s).alias("masks"))
                    for f in FIELD_ORDER for s in FIELD_SYNONYMS[f]])
    cat = sanitized_catalog(catalog).where(~F.col("sanitized").isin(BLOCKLIST))
    # Each distinct name is scored once, however many sources carry it.
    pairs = cat.select("sanitized").distinct().select("sanitized", F.inline(syn))
    common = lcs_by_bits(F.col("sanitized"), F.col("masks"), F.col("size"))
    scored = (pairs.withColumn("score", F.lit(200.0) * common / (F.length("sanitized") + F.col("size")))
              .groupBy("sanitized", "field", "field_rank")
              .agg(F.max("score").alias("score"), F.bool_or(F.col("sanitized") == F.col("synonym")).alias("exact")))
    return cat.join(scored, "sanitized").select(
        "source_id", "ordinal", "column", "sanitized", "field", "field_rank", "score", "exact")


def auto_map_columns(catalog: DataFrame) -> DataFrame:
    """M4: greedy one-to-one assignment in field order. An exact synonym wins
    at once (first by ordinal); otherwise the best score >= 75, first column
    on ties. A column serves one field. Five fixed rounds, all sources at once.
    Returns (source_id, field, column, score); unmapped fields are absent."""
    scores = materialize(catalog.sparkSession, name_match_scores(catalog).where(
        F.col("exact") | (F.col("score") >= FUZZY_THRESHOLD)), "name-scores")
    assigned = None
    for f in FIELD_ORDER:
        cand = scores.where(F.col("field") == f)
        if assigned is not None:
            cand = cand.join(assigned.select("source_id", "ordinal"), ["source_id", "ordinal"], "left_anti")
        w = Window.partitionBy("source_id").orderBy(F.col("exact").desc(), F.col("score").desc(), "ordinal")
        pick = (cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
                    .select("source_id", "field", "ordinal", "column",
                            F.when(F.col("exact"), F.lit(100.0)).otherwise(F.col("score")).alias("score")))
        assigned = pick if assigned is None else assigned.unionByName(pick)
    return assigned


def best_columns(catalog: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The best column of every field on its own (same order of preference), as a user picks them one by one:
    a column may be picked for several fields, which ``duplicate_mappings`` reports."""
    scores = name_match_scores(catalog).where(F.col("exact") | (F.col("score") >= threshold))
    w = Window.partitionBy("source_id", "field").orderBy(F.col("exact").desc(), F.col("score").desc(), "ordinal")
    return (scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
                  .select("source_id", "field", "ordinal", "column"))


def unmapped_fields(mapping: DataFrame, sources: DataFrame) -> DataFrame:
    """M5: required fields without a column, per source."""
    req = sources.select("source_id", F.explode(F.array(*[F.lit(f) for f in REQUIRED_FIELDS])).alias("field"))
    return req.join(mapping.select("source_id", "field"), ["source_id", "field"], "left_anti")


def duplicate_mappings(mapping: DataFrame) -> DataFrame:
    """M6: a column chosen for more than one field."""
    return (mapping.groupBy("source_id", "column").agg(F.count(F.lit(1)).alias("n_fields"),
                                                       F.array_sort(F.collect_list("field")).alias("fields"))
                   .where(F.col("n_fields") > 1))


def _signatures() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("preset"), F.lit(rank).alias("preset_rank"),
                              F.lit(field).alias("field"), F.lit(col).alias("signature_column"))
                     for rank, (name, sig) in enumerate(PRESET_SIGNATURES) for field, col in sig.items()])


def detect_preset(catalog: DataFrame) -> DataFrame:
    """M8: the first preset (priority order) whose four signature columns all
    exist, compared on lower-cased trimmed names."""
    cat = catalog.select("source_id", F.lower(F.trim(F.col("column"))).alias("key")).distinct()
    sig = catalog.select("source_id").distinct().select("source_id", F.inline(_signatures()))
    hits = sig.join(cat, (sig.source_id == cat.source_id) & (sig.signature_column == cat.key)) \
              .select(sig.source_id, "preset", "preset_rank", "field")
    full = (hits.groupBy("source_id", "preset", "preset_rank")
                .agg(F.count_distinct("field").alias("n")).where(F.col("n") == 4))
    return full.groupBy("source_id").agg(F.min_by("preset", "preset_rank").alias("preset"))


def preset_mapping(catalog: DataFrame, presets: DataFrame) -> DataFrame:
    """M9: a detected preset's columns (original spelling, first match by
    ordinal) plus ``currency`` by exact name."""
    cat = catalog.withColumn("key", F.lower(F.trim(F.col("column"))))
    sig = presets.select("source_id", "preset", F.inline(_signatures()).alias(
        "sig_preset", "preset_rank", "field", "signature_column")).where(F.col("preset") == F.col("sig_preset"))
    cur = presets.select("source_id", F.lit("currency").alias("field"), F.lit("currency").alias("signature_column"))
    want = sig.select("source_id", "field", "signature_column").unionByName(cur)
    j = want.join(cat, (want.source_id == cat.source_id) & (want.signature_column == cat.key)) \
            .select(want.source_id, "field", "ordinal", "column")
    w = Window.partitionBy("source_id", "field").orderBy("ordinal")
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def resolve_mapping(catalog: DataFrame) -> DataFrame:
    """The upload flow: a detected preset's mapping when there is one (fuzzy
    fills a missing currency), the fuzzy mapping otherwise."""
    presets = detect_preset(catalog)
    pm = preset_mapping(catalog, presets).select("source_id", "field", "column", F.lit("preset").alias("how"))
    fuzzy = auto_map_columns(catalog).select("source_id", "field", "column", F.lit("fuzzy").alias("how"))
    fill = fuzzy.join(pm.select("source_id", "field"), ["source_id", "field"], "left_anti")
    with_preset = fill.join(presets.select("source_id"), "source_id", "left_semi").where(F.col("field") == "currency")
    no_preset = fuzzy.join(presets.select("source_id"), "source_id", "left_anti")
    return pm.unionByName(with_preset).unionByName(no_preset)


def rename_plan(mapping_rows: list[tuple[str, str]]) -> dict[str, str]:
    """M7: {original column: canonical field} for one source."""
    return {col: field for field, col in mapping_rows if col is not None and col != field}


def apply_mapping(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """M7: rename mapped columns; unmapped columns pass through. A canonical
    name already used by an unmapped column is dropped first (pandas would
    keep two equal names; Spark cannot)."""
    shadowed = [c for c in df.columns if c in set(renames.values()) and c not in renames]
    out = df.drop(*shadowed)
    return out.withColumnsRenamed(renames)
