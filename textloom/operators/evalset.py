"""Evaluation sets: materialised parts of the reserved rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dataset import Filters, allocated
from .ranking import first_by_hash
from ..hashing import portable_hash
from ..schema import RESERVED
from ..storage import small_enough


def members_of(chosen: DataFrame, reservation_id: int, first_id: int, split: str | None = "test") -> DataFrame:
    """Membership rows of a run; list selectors have no split of their own: all are test."""
    out = chosen.select("sample_id", *[c for c in ("evaluation_split", "human_verify", "annotations") if c in chosen.columns])
    if "evaluation_split" not in out.columns:
        out = out.withColumn("evaluation_split", F.lit(split))
    if "human_verify" not in out.columns:
        out = out.withColumn("human_verify", F.lit(False))
    return out.withColumn("reservation_id", F.lit(reservation_id)).withColumn("id", F.lit(first_id) + F.monotonically_increasing_id())


def rows(corpus: DataFrame, registry: DataFrame, members: DataFrame, filters: Filters, reservation_ids: list[int] | None = None, sample_ids: DataFrame | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Reserved rows with split and review flag of their membership, filtered; *limit* of them by hash.

    A sample of several runs has a row for each.  sample_ids: (sample_id), to take only these.
    """
    m = members.filter(F.col("reservation_id").isin(reservation_ids)) if reservation_ids else members
    base = allocated(corpus.drop("evaluation_split", "human_verify"), registry, RESERVED)
    if sample_ids is not None:
        base = base.join(F.broadcast(sample_ids) if small_enough(sample_ids, 1_000_000) else sample_ids, "sample_id", "left_semi")
    out = base.join(m.select("sample_id", "reservation_id", "evaluation_split", "human_verify"), "sample_id").filter(filters.condition())
    if limit is None:
        return out
    hashed = out.withColumn("_h", portable_hash(F.col("sample_id"), str(seed))).withColumn("_all", F.lit(0))
    return first_by_hash(hashed, ["_all"], "_h", ["sample_id", "reservation_id"], F.lit(limit)).drop("_h", "_all")


def page(table: DataFrame, filters: Filters, limit: int, offset: int = 0) -> tuple[int, DataFrame]:
    """How many rows meet the filters, and one page of them by id."""
    kept = table.filter(filters.condition())
    return kept.count(), kept.orderBy("id").offset(offset).limit(limit)


def batch_status(batches: DataFrame, batch_id: int, status: str) -> DataFrame:
    """Batches with one of them rejected or restored; only ready and rejected ones can change."""
    if status not in ("ready", "rejected"):
        raise ValueError(f"a batch cannot become {status!r}")
    change = (F.col("id") == batch_id) & F.col("status").isin("ready", "rejected")
    return batches.withColumn("status", F.when(change, status).otherwise(F.col("status")))
