"""Canonical schema of a corpus row and the allocation states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TRAINABLE, RESERVED, QUARANTINED, IGNORED = "TRAINABLE", "RESERVED_EVALUATION", "QUARANTINED", "IGNORED"
ALLOCATIONS = (TRAINABLE, RESERVED, QUARANTINED, IGNORED)
#: Label of rows whose sample is not registered.
MISSING = "MISSING"

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


BASE = _struct(
    "sample_id long, batch_id int, source_id int, src_lang string, tgt_lang string, domain string, quality double, document_id string, source_text string, target_text string, meta string"
)
FEATURES = _struct(
    "n_tokens int, length_bucket string, has_math boolean, has_numbers_units boolean, has_acronyms boolean, has_mixed_script boolean, is_rare_term boolean, "
    "rare_term_score double, evaluation_split string, human_verify boolean, allocation string"
)
CANONICAL = T.StructType(BASE.fields + FEATURES.fields)


def empty(spark: SparkSession) -> DataFrame:
    """The canonical relation without rows."""
    return spark.createDataFrame([], CANONICAL)


def backfilled(df: DataFrame, schema: T.StructType = CANONICAL) -> DataFrame:
    """*df* with every canonical column, absent ones as typed nulls, further columns after them."""
    have = set(df.columns)
    canonical = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    names = {f.name for f in schema}
    return df.select(*canonical, *[c for c in df.columns if c not in names])


def union_by_name(frames: list[DataFrame], spark: SparkSession) -> DataFrame:
    """All rows, columns matched by name, absent ones null; the empty relation for no frames."""
    if not frames:
        return empty(spark)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
