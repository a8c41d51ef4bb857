"""Datasets as lazy queries: filters, per-batch composition, allocation, splits, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import first_by_hash
from ..hashing import portable_hash, unit_hash
from ..schema import MISSING, TRAINABLE
from ..storage import small_enough

#: Ids up to this many are broadcast in allocation joins; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


@dataclass
class Filters:
    """Row predicates; an empty one is true.  Bounds on quality drop nulls, as comparisons do."""

    src_lang: list[str] = field(default_factory=list)
    tgt_lang: list[str] = field(default_factory=list)
    domain: list[str] = field(default_factory=list)
    source_id: list[int] = field(default_factory=list)
    batch_id: list[int] = field(default_factory=list)
    min_quality: float | None = None
    max_quality: float | None = None
    contains: str | None = None
    evaluation_split: list[str] = field(default_factory=list)
    human_verify: bool | None = None

    def condition(self) -> Column:
        parts = [F.col(c).isin(getattr(self, c)) for c in ("src_lang", "tgt_lang", "domain", "source_id", "batch_id", "evaluation_split") if getattr(self, c)]
        if self.min_quality is not None:
            parts.append(F.col("quality") >= self.min_quality)
        if self.max_quality is not None:
            parts.append(F.col("quality") <= self.max_quality)
        if self.contains:
            like = "%" + self.contains.replace("\\", "\\\\") + "%"  # wildcards in the needle are live
            parts.append(F.col("source_text").ilike(like) | F.col("target_text").ilike(like))
        if self.human_verify is not None:
            parts.append(F.col("human_verify").eqNullSafe(F.lit(self.human_verify)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass
class BatchRule:
    """How much of a batch a dataset takes: all, a percentage in (0, 100], or a count of at least 1."""

    batch_id: int
    mode: str = "all"
    value: float | None = None

    def __post_init__(self) -> None:
        ok = {"all": self.value is None, "percent": self.value is not None and 0 < self.value <= 100, "count": self.value is not None and self.value >= 1 and float(self.value).is_integer()}
        if not ok.get(self.mode, False):
            raise ValueError(f"batch {self.batch_id}: bad rule {self.mode} {self.value}")

    def limit(self) -> Column:
        n = F.col("n")
        return {"all": n, "percent": F.ceil(n * F.lit(self.value) / 100), "count": F.lit(int(self.value or 0))}[self.mode].cast("long")


def check_rules(rules: list[BatchRule], batches: DataFrame) -> None:
    """At most one rule a batch, and only batches that exist and are ready."""
    ids = [r.batch_id for r in rules]
    if len(ids) != len(set(ids)):
        raise ValueError("more than one rule for a batch")
    check_batches(ids, batches)


def check_batches(ids: list[int], batches: DataFrame) -> None:
    found = {r.id: r.status for r in batches.filter(F.col("id").isin(ids)).select("id", "status").collect()}  # as many rows as were asked for
    unknown, late = sorted(set(ids) - set(found)), sorted(i for i, s in found.items() if s != "ready")
    if unknown or late:
        raise ValueError(f"unknown batches {unknown}, batches that are not ready {late}")


def ready_batches(batches: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Batches that datasets may read: ready and stored."""
    out = batches.filter((F.col("status") == "ready") & F.col("parquet_uri").isNotNull())
    return out.filter(F.col("id").isin(ids)) if ids else out


def compose(rows: DataFrame, filters: Filters, rules: list[BatchRule] | None = None, batch_ids: list[int] | None = None, seed: int = 42) -> DataFrame:
    """The dataset's rows: filters first, then each batch's first rows in the order of their hash.

    Ranks are over filtered rows and before allocation: taking a row out later
    never pulls another one in.  Rules override the plain list of batches.
    """
    kept = rows.filter(filters.condition())
    if not rules:
        return kept.filter(F.col("batch_id").isin(batch_ids)) if batch_ids else kept
    everything = [r.batch_id for r in rules if r.mode == "all"]
    partial = [r for r in rules if r.mode != "all"]
    out = kept.filter(F.col("batch_id").isin(everything)) if everything else None
    if partial:
        limit = None
        for r in partial:
            cond = F.col("batch_id") == r.batch_id
            limit = F.when(cond, r.limit()) if limit is None else limit.when(cond, r.limit())
        hashed = kept.filter(F.col("batch_id").isin([r.batch_id for r in partial])).withColumn("_h", portable_hash(F.col("sample_id"), str(seed)))
        some = first_by_hash(hashed, ["batch_id"], "_h", ["sample_id"], limit).drop("_h")
        out = some if out is None else out.unionByName(some)
    return out


def allocated(rows: DataFrame, registry: DataFrame, allocation: str = TRAINABLE) -> DataFrame:
    """Rows with one allocation.  registry: (sample_id, allocation), the authority.

    For TRAINABLE the others are taken away (rows that the registry lacks stay);
    for another state its ids are looked up: the small side either way.
    """
    if allocation == TRAINABLE:
        ids, how = registry.filter(F.col("allocation") != TRAINABLE), "left_anti"
    else:
        ids, how = registry.filter(F.col("allocation") == allocation), "left_semi"
    ids = ids.select("sample_id")
    return rows.join(F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids, "sample_id", how)


def with_allocation(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with their current allocation; MISSING where the registry has none."""
    return rows.drop("allocation").join(registry.select("sample_id", "allocation"), "sample_id", "left").withColumn("allocation", F.coalesce("allocation", F.lit(MISSING)))


RATIOS = {"train": 0.9, "validation": 0.05, "test": 0.05}


def split_of(sample_id: Column, ratios: dict[str, float] | None = None, seed: int = 42) -> Column:
    """Split by cumulative ratios over a hash in [0, 1); what lies above the last edge is test."""
    r = RATIOS | (ratios or {})
    b = (portable_hash(sample_id, str(seed)) % 1_000_000) / F.lit(1e6)
    return F.when(b < r["train"], "train").when(b < r["train"] + r["validation"], "validation").otherwise("test")


def counted(rows: DataFrame, key: Column, name: str, limit: int = 100) -> DataFrame:
    """Row counts by a key, the most frequent first, ties by the key."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(limit)


def statistics(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts by language pair, domain, source and batch, each from one aggregate."""
    return {
        "language_pair": counted(rows, F.concat("src_lang", F.lit("-"), "tgt_lang"), "language_pair"),
        "domain": counted(rows, F.coalesce("domain", F.lit("unknown")), "domain"),
        "source": counted(rows, F.col("source_id"), "source_id"),
        "batch": counted(rows, F.col("batch_id"), "batch_id"),
    }


def allocation_counts(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows by allocation, and all as 'composed', in one pass."""
    return with_allocation(rows, registry).rollup("allocation").agg(F.count("*").alias("n")).withColumn("allocation", F.coalesce("allocation", F.lit("composed")))


def preview(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy("sample_id").offset(offset).limit(limit)


def listing(table: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first."""
    return table.orderBy(F.desc("id")).offset(offset).limit(limit)


def point(rows: DataFrame, sample_id: int) -> DataFrame:
    return rows.filter(F.col("sample_id") == sample_id)


def search(rows: DataFrame, registry: DataFrame, filters: Filters, allocation: str = TRAINABLE, limit: int = 50, offset: int = 0) -> DataFrame:
    """One allocation's rows that meet the filters, a page of them."""
    return preview(allocated(rows.filter(filters.condition()), registry, allocation), limit, offset)


#: Ids that are hashed together before the digests are.
DIGEST_RANGE = 1 << 20


def id_digest(rows: DataFrame, group: list[str], id_col: str = "sample_id", span: int = DIGEST_RANGE) -> DataFrame:
    """SHA-256 of each group's ids, and their number.

    Ids fall into ranges of *span* values; a range's digest is that of its ids,
    ascending and comma-joined, a group's that of its ranges' digests in order.  No
    task holds more than *span* ids of a group.
    """
    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")

    ranges = rows.withColumn("_r", F.floor(F.col(id_col) / span)).groupBy(*group, "_r").agg(F.sha2(joined(id_col), 256).alias("_d"), F.count("*").alias("_n"))
    placed = F.array_sort(F.collect_list(F.struct("_r", "_d")))  # one entry for each range
    return ranges.groupBy(*group).agg(F.sha2(F.array_join(F.transform(placed, lambda x: x["_d"]), ","), 256).alias("digest"), F.sum("_n").alias("n"))
