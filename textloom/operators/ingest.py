"""From raw rows to canonical ones: projection, validity, import deduplication, ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .selection import dedup_language_aware
from ..functions.language import strip
from ..schema import BASE


@dataclass
class Mapping:
    """Raw column of each canonical field; None: absent."""

    source_text: str = "source"
    target_text: str = "target"
    src_lang: str | None = None
    tgt_lang: str | None = None
    domain: str | None = None
    quality: str | None = None
    document_id: str | None = None
    meta_columns: list[str] = field(default_factory=list)


def normalize(raw: DataFrame, mapping: Mapping, batch_id: int, source_id: int, src_lang: str, tgt_lang: str, order: str | None = None, domain: str | None = None) -> DataFrame:
    """Canonical rows without ids: mapped columns or defaults, both texts stripped and non-empty, the rest packed as JSON."""
    missing = [c for c in (mapping.source_text, mapping.target_text) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing text columns: {', '.join(missing)}")

    def pick(name: str | None, default: Column) -> Column:
        return F.col(f"`{name}`").cast("string") if name and name in raw.columns else default  # a mapped value stays what it is, null or blank too

    extra = [c for c in mapping.meta_columns if c in raw.columns]
    meta = F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra]), {"ignoreNullFields": "false"}) if extra else F.lit(None).cast("string")
    out = raw.select(
        F.lit(batch_id).alias("batch_id"), F.lit(source_id).alias("source_id"),
        pick(mapping.src_lang, F.lit(src_lang)).alias("src_lang"), pick(mapping.tgt_lang, F.lit(tgt_lang)).alias("tgt_lang"),
        pick(mapping.domain, F.lit(domain).cast("string")).alias("domain"),
        (F.expr(f"try_cast(`{mapping.quality}` as double)") if mapping.quality in raw.columns else F.lit(None).cast("double")).alias("quality"),
        pick(mapping.document_id, F.lit(None).cast("string")).alias("document_id"),
        strip(F.col(f"`{mapping.source_text}`").cast("string")).alias("source_text"), strip(F.col(f"`{mapping.target_text}`").cast("string")).alias("target_text"),
        meta.alias("meta"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_position"),
    )
    return out.filter((F.length("source_text") > 0) & (F.length("target_text") > 0))


def with_ids(rows: DataFrame, first: int) -> DataFrame:
    """Consecutive ids from *first* in order of position: counts per range are gathered, rows are not."""
    keyed = rows.repartitionByRange("_position").sortWithinPartitions("_position").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    from ..storage import cut

    keyed = cut(keyed, "ingest-positions")
    sizes = sorted((r["_p"], r["n"]) for r in keyed.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row a partition
    start, offsets = first, []
    for p, n in sizes:
        offsets.append((p, start))
        start += n
    if not offsets:
        return keyed.select(F.lit(0).cast("long").alias("sample_id"), "*").drop("_p", "_i", "_position")
    base = F.broadcast(keyed.sparkSession.createDataFrame(offsets, "_p int, _first long"))
    return keyed.join(base, "_p").select((F.col("_first") + F.col("_i")).alias("sample_id"), *[f.name for f in BASE if f.name != "sample_id"])


def ingest(raw: DataFrame, mapping: Mapping, batch_id: int, source_id: int, src_lang: str, tgt_lang: str, first_id: int) -> DataFrame:
    """normalize, ids in input order, the first of rows with equal language-aware keys."""
    return dedup_language_aware(with_ids(normalize(raw, mapping, batch_id, source_id, src_lang, tgt_lang), first_id))


def batch_statistics(rows: DataFrame) -> DataFrame:
    """Rows in all, by language pair and by domain, in one GROUPING SETS pass: (kind, key, n)."""
    keyed = rows.select(F.concat("src_lang", F.lit("-"), "tgt_lang").alias("language_pair"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
    got = keyed.groupingSets([["language_pair"], ["domain"], []], "language_pair", "domain").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 1, "language_pair").when(F.col("g") == 2, "domain").otherwise("rows")
    return got.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("language_pair")).when(F.col("g") == 2, F.col("domain")).otherwise("all").alias("key"), "n")
