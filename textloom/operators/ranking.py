"""The first k rows of each group by hash, without sorting whole groups.

A window over a group puts the group into one task; a group may hold a third of
all rows.  Here the hash is counted into ``BINS`` ranges per group first (a
map-side combined aggregate); only the range that holds the k-th row is ranked,
about group / BINS rows.  Ties are broken by further columns, so the result is
total-ordered and the same for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..hashing import DIGITS

BINS = 4096
_SHIFT = 16**DIGITS // BINS


def first_by_hash(df: DataFrame, group: list[str], hash_col: str, ties: list[str], limit: Column) -> DataFrame:
    """Rows of *df* with the *limit* least (hash_col, ties) in their group.

    limit: an expression over the group columns and ``n``, the group's row count.
    hash_col: a long in [0, 2**32).  A null limit keeps nothing.
    """
    bins = df.groupBy(*group, (F.col(hash_col) / _SHIFT).cast("long").alias("_bin")).agg(F.count("*").alias("_c"))
    by_group = Window.partitionBy(*group)  # at most BINS rows a group
    upto = bins.withColumn("n", F.sum("_c").over(by_group)).withColumn("_upto", F.sum("_c").over(by_group.orderBy("_bin")))
    cutoff = upto.withColumn("_k", limit).filter((F.col("_upto") - F.col("_c") < F.col("_k"))).groupBy(*group).agg(
        F.max("_bin").alias("_last"), F.max_by("_k", "_bin").alias("_k"), F.max_by(F.col("_upto") - F.col("_c"), "_bin").alias("_before")
    )
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    names = df.columns
    rows = df.alias("l").join(cutoff.alias("r"), cond).select("l.*", "r._last", "r._k", "r._before").withColumn("_bin", (F.col(hash_col) / _SHIFT).cast("long")).filter("_bin <= _last")
    inside = rows.filter("_bin < _last").select(*names)
    edge = rows.filter("_bin = _last").withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(hash_col, *ties))).filter(F.col("_r") + F.col("_before") <= F.col("_k")).select(*names)
    return inside.unionByName(edge)


def keep_first(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """One row for each key, the least by *order* then id: an aggregate picks ids, no group is collected."""
    best = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in order if c != id_col], id_col)).alias("_b")).select(F.col(f"_b.{id_col}").alias(id_col))
    return df.join(best, id_col, "left_semi")
