"""The allocation state machine, memberships and annotations, as joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import first_by_hash
from ..schema import IGNORED, QUARANTINED, RESERVED, TRAINABLE
from ..storage import small_enough


def restored(reserved_at: Column, quarantined_at: Column) -> Column:
    """What a sample falls back to: quarantine is permanent, then reservation."""
    return F.when(quarantined_at.isNotNull(), QUARANTINED).when(reserved_at.isNotNull(), RESERVED).otherwise(TRAINABLE)


def imported(rows: DataFrame, reserved: DataFrame, quarantined: DataFrame, dev: DataFrame, gold: DataFrame) -> DataFrame:
    """Import allocation, evaluation split and gold flag from four id sets (sample_id)."""
    out = rows
    for name, ids in (("_r", reserved), ("_q", quarantined), ("_d", dev), ("_g", gold)):
        out = out.join(ids.select("sample_id").distinct().withColumn(name, F.lit(True)), "sample_id", "left")
    r = F.coalesce("_r", F.lit(False))
    state = F.when(r, RESERVED).when(F.coalesce("_q", F.lit(False)), QUARANTINED).otherwise(TRAINABLE)
    split = F.when(r, F.when(F.coalesce("_d", F.lit(False)), "dev").otherwise("test"))
    return out.withColumn("allocation", state).withColumn("evaluation_split", split).withColumn("human_verify", F.coalesce("_g", F.lit(False)) & r).drop("_r", "_q", "_d", "_g")


def transition(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """samples after requests (sample_id, wanted, at), one request a sample.

    Asking for TRAINABLE restores a protected sample; asking for RESERVED leaves
    a quarantined one quarantined; time stamps are set once.
    """
    s = samples.alias("s").join(requests.alias("q"), F.col("s.id") == F.col("q.sample_id"), "left")
    wanted, at = F.col("q.wanted"), F.col("q.at")
    state = (
        F.when(wanted.isNull(), F.col("s.allocation"))
        .when(wanted == TRAINABLE, restored(F.col("s.reserved_at"), F.col("s.quarantined_at")))
        .when((wanted == RESERVED) & F.col("s.quarantined_at").isNotNull(), QUARANTINED)
        .otherwise(wanted)
    )
    reserved_at = F.coalesce("s.reserved_at", F.when(state == RESERVED, at))
    quarantined_at = F.coalesce("s.quarantined_at", F.when(state == QUARANTINED, at))
    return s.select(F.col("s.id").alias("id"), state.alias("allocation"), reserved_at.alias("reserved_at"), quarantined_at.alias("quarantined_at"))


def applied(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dataset-level reservation: chosen (sample_id, to, at) changes only samples that are still TRAINABLE."""
    s = samples.alias("s").join(chosen.alias("c"), F.col("s.id") == F.col("c.sample_id"), "left")
    hit = F.col("c.to").isNotNull() & (F.col("s.allocation") == TRAINABLE)
    return s.select(
        F.col("s.id").alias("id"),
        F.when(hit, F.col("c.to")).otherwise(F.col("s.allocation")).alias("allocation"),
        F.when(hit & (F.col("c.to") == RESERVED), F.col("c.at")).otherwise(F.col("s.reserved_at")).alias("reserved_at"),
        F.when(hit & (F.col("c.to") == QUARANTINED), F.col("c.at")).otherwise(F.col("s.quarantined_at")).alias("quarantined_at"),
    )


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last decision and the last quality of each sample; ties in time by the higher id."""
    order = F.struct("created_at", "id")
    decided = F.max_by("ignored", F.when(F.col("ignored").isNotNull(), order))
    quality = F.max_by("quality", F.when(F.col("quality").isNotNull(), order))
    return annotations.filter("sample_id is not null").groupBy("sample_id").agg(decided.alias("ignored"), quality.alias("new_quality"))


def annotated(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Samples under their annotations: ignored ones are IGNORED, un-ignored ones restored, quality overridden."""
    s = samples.join(latest_annotations(annotations), samples["id"] == F.col("sample_id"), "left")
    state = F.when(F.col("ignored"), IGNORED).when(F.col("ignored") == F.lit(False), F.when(F.col("allocation") == IGNORED, restored(F.col("reserved_at"), F.col("quarantined_at"))).otherwise(F.col("allocation"))).otherwise(F.col("allocation"))
    return s.select("id", state.alias("allocation"), F.coalesce("new_quality", "quality").alias("quality"))


def migrated(status: Column) -> Column:
    """Allocation of the earlier status column."""
    return F.when(status == "ignored", IGNORED).otherwise(TRAINABLE)


def revertible(reservations: DataFrame, run: int) -> DataFrame:
    """Why a reservation run cannot be reverted; no row: it can."""
    one = reservations.filter(F.col("id") == run)
    blockers = [
        one.filter(F.col("status") != "completed").select(F.lit("not completed").alias("blocker")),
        one.filter("applied_at is null").select(F.lit("never applied").alias("blocker")),
        reservations.filter(F.col("status").isin("queued", "running")).select(F.lit("a run is active").alias("blocker")),
        reservations.alias("l").join(one.alias("o"), F.col("l.applied_at") > F.col("o.applied_at")).select(F.lit("a later run was applied").alias("blocker")),
    ]
    out = blockers[0]
    for b in blockers[1:]:
        out = out.unionByName(b)
    return out.distinct()


def reverted(samples: DataFrame, members: DataFrame, applied_at: Column) -> DataFrame:
    """Samples after a run is taken back: stamp and allocation must both match; ignored rows keep their state but lose the stamp."""
    m = members.select("sample_id").distinct()
    s = samples.join(m.withColumn("_m", F.lit(True)), samples["id"] == F.col("sample_id"), "left").drop("sample_id")
    r = F.col("_m") & (F.col("reserved_at") == applied_at)
    q = F.col("quarantined_at") == applied_at
    reserved_at = F.when(F.coalesce(r, F.lit(False)), F.lit(None)).otherwise(F.col("reserved_at"))
    quarantined_at = F.when(F.coalesce(q, F.lit(False)), F.lit(None)).otherwise(F.col("quarantined_at"))
    back = F.coalesce(r, F.lit(False)) & (F.col("allocation") == RESERVED) | F.coalesce(q, F.lit(False)) & (F.col("allocation") == QUARANTINED)
    return s.select("id", F.when(back, TRAINABLE).otherwise(F.col("allocation")).alias("allocation"), reserved_at.alias("reserved_at"), quarantined_at.alias("quarantined_at"))


def purge_blockers(members: DataFrame, samples: DataFrame, reservations: DataFrame) -> DataFrame:
    """(batch_id, reservation_id, dataset_id): reservation runs that hold samples of a batch."""
    m = members.select("sample_id", "reservation_id")
    s = samples.select(F.col("id").alias("sample_id"), "batch_id")
    r = reservations.select(F.col("id").alias("reservation_id"), "dataset_id")
    return m.join(s, "sample_id").join(F.broadcast(r) if small_enough(r, 100_000) else r, "reservation_id").select("batch_id", "reservation_id", "dataset_id").distinct()


def batch_annotations(annotations: DataFrame, samples: DataFrame) -> DataFrame:
    """Annotations of each batch."""
    return annotations.join(samples.select(F.col("id").alias("sample_id"), "batch_id"), "sample_id").groupBy("batch_id").agg(F.count("*").alias("n"))


def uses_batch(batch_id: int, filter_ids: list[int] | None, rules: list[int] | None, batch_ids: list[int] | None) -> bool:
    """Whether a dataset reads a batch: filter ids win over rules, rules over the list, nothing means all."""
    for ids in (filter_ids, rules, batch_ids):
        if ids:
            return batch_id in ids
    return True


def historical_overlap(snapshot: DataFrame, reserved: DataFrame, keep_ids: int = 10_000) -> DataFrame:
    """Rows of earlier snapshots (snapshot_id, sample_id) that are reserved now: exact count, and the first ids.

    The kept list is a report of bounded length; the count is over all rows.
    """
    hits = snapshot.join(reserved.select("sample_id").distinct(), "sample_id", "left_semi").select("snapshot_id", "sample_id").distinct()
    ends = hits.groupBy("snapshot_id").agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"), F.count("*").alias("n"))
    # Ids scaled to the range that the ranking bins, in their order: no snapshot is sorted whole.
    scaled = ((F.col("sample_id") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1) * 2.0**32).cast("long")
    placed = hits.join(ends, "snapshot_id").withColumn("_at", F.least(scaled, F.lit(2**32 - 1))).select("snapshot_id", "sample_id", "_at")
    first = first_by_hash(placed, ["snapshot_id"], "_at", ["sample_id"], F.lit(keep_ids))
    ids = first.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))  # keep_ids at most
    return ends.select("snapshot_id", "n").join(ids, "snapshot_id")
