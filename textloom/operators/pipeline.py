"""Reserving evaluation data end to end: candidates, selection, splits, scan, states.

The order is fixed: annotate, exact and near deduplication, choice of held-out
documents under a budget of corpus rows, quotas per (pair, domain, length
bucket), top-up of rare phenomena, development and test, rows for human review,
scan of all rows.  Rows stay in DataFrames throughout; the driver sees the
candidates' documents (at most ``candidates.limit``), counts per cell and a report.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import contamination as C, selection as S
from .dataset import compose, Filters
from .ranking import first_by_hash
from ..functions import language as L
from ..hashing import portable_hash
from ..policy import DEFAULT, for_pair, validated  # noqa: F401
from ..storage import cut, small_enough

FLAGS = ("has_math", "has_numbers_units", "has_acronyms", "has_mixed_script")
CELL = ["pair", "domain", "length_bucket"]


@dataclass
class Reservation:
    """What a run decides: members (sample_id, evaluation_split, human_verify), quarantined (sample_id, reason), report."""

    members: DataFrame
    quarantined: DataFrame
    report: dict[str, Any]


def by_quota(rows: DataFrame, quotas: dict[tuple[str, str, str], int], seed: int) -> DataFrame:
    """The first rows by hash of each cell, as many as its quota."""
    spark = rows.sparkSession
    limits = spark.createDataFrame([(*k, v) for k, v in sorted(quotas.items())], "pair string, domain string, length_bucket string, quota long")
    limited = rows.withColumn("_h", portable_hash(F.col("sample_id"), str(seed), "quota")).join(F.broadcast(limits), CELL)  # a row for each cell
    return first_by_hash(limited, [*CELL, "quota"], "_h", ["sample_id"], F.col("quota")).drop("_h", "quota")


def held_documents(pool: DataFrame, corpus: DataFrame, policy: dict[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """(pair, document) that a reservation may draw from, and what holding them costs, by pair and in all.

    Each pair has a budget of its own policy's share of its part of the corpus; the
    pool's proportions stand for the corpus's.  A document costs the corpus rows
    that it has.  The driver sees a row for each document of the pool.
    """
    spark = pool.sparkSession
    flags = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    docs = pool.groupBy("pair", "document").agg(F.count("*").alias("rows"), F.min_by("domain", "sample_id").alias("domain"), (2.0 * F.countDistinct("length_bucket") + F.avg(flags)).alias("value"))
    docs = cut(docs, "reserve-documents")
    key = L.document_key(F.col("document_id"), F.col("sample_id"), F.col("source_id"))
    named = docs.select("document").distinct().filter("not startswith(document, 'sample:')")
    sizes = corpus.select(key.alias("document")).join(F.broadcast(named) if small_enough(named, 200_000) else named, "document", "left_semi").groupBy("document").agg(F.count("*").alias("size"))
    by_pair: dict[str, list] = {}
    for r in docs.join(sizes, "document", "left").orderBy("pair", "document").collect():  # the candidates' documents
        by_pair.setdefault(r.pair, []).append(r)
    total, pooled = corpus.count(), sum(r.rows for rows in by_pair.values() for r in rows)
    kept, reports = [], {}
    for pair, rows in by_pair.items():
        d = for_pair(policy, pair)["documents"]
        share = max(1, round(total * sum(r.rows for r in rows) / pooled))
        budget = S.holdout_budget(share, d["budget_share"], d["budget_rows"])
        chosen, cost = S.choose_documents([(r.document, r.domain, r.value, r.rows) for r in rows], {r.document: r["size"] or 1 for r in rows}, budget, d["most"])
        kept += [(pair, k) for k in chosen]
        reports[pair] = {"budget_rows": budget, "corpus_rows": share, "estimated_rows": cost, "documents_held": len(chosen), "documents_available": len(rows), "applied": len(chosen) < len(rows)}
    return spark.createDataFrame(kept, "pair string, document string"), merged_reports(reports)


def merged_reports(reports: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """The pairs' holdout reports and their sums; a sum is unknown where one of its parts is."""
    out: dict[str, Any] = {"by_pair": reports, "applied": any(r["applied"] for r in reports.values())}
    for name in ("budget_rows", "corpus_rows", "estimated_rows", "documents_held", "documents_available"):
        values = [r[name] for r in reports.values()]
        out[name] = None if None in values else sum(values)
    return out


def diverse(rows: DataFrame, quotas: dict[tuple[str, str, str], int], vectors: DataFrame, seed: int) -> DataFrame:
    """As many rows of each cell as its quota, each farthest from those taken before (ties by hash).

    A cell is a part of the candidates, whose number the policy bounds.
    """
    spark = rows.sparkSession
    limits = spark.createDataFrame([(*k, v) for k, v in sorted(quotas.items())], "pair string, domain string, length_bucket string, quota long")
    placed = rows.select("sample_id", *CELL).join(F.broadcast(limits), CELL).join(vectors.select("sample_id", F.col("v").cast("array<double>").alias("v")), "sample_id")
    placed = placed.withColumn("h", portable_hash(F.col("sample_id"), str(seed), "quota"))

    def pick(cell):
        cell = cell.sort_values(["h", "sample_id"], ignore_index=True)
        n = min(int(cell["quota"].iloc[0]), len(cell))
        m = np.stack(cell["v"].to_numpy())
        m = m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, norm)
        taken, far = [0], 1 - m @ m[0]
        while len(taken) < n:
            far[taken] = -1
            taken.append(int(far.argmax()))
            far = np.minimum(far, 1 - m @ m[taken[-1]])
        return cell.loc[taken[:n], ["sample_id"]]

    return rows.join(placed.groupBy(*CELL).applyInPandas(pick, "sample_id long"), "sample_id", "left_semi")


def top_up(pool: DataFrame, chosen: DataFrame, least: dict[str, int], seed: int, vectors: DataFrame | None = None) -> DataFrame:
    """*chosen* with at least least[flag] rows of each flag, as far as the pool has them; its size stays.

    Rows come in from the pool in the order of their hash, or those least similar
    to the chosen ones where vectors (sample_id, v) are given; rows without any
    flag leave, in the order of their hash.
    """
    flags = [f for f in FLAGS if f in pool.columns]
    for flag, want in sorted(least.items()):
        have = chosen.filter(flag).count()
        room = chosen.filter(~sum((F.col(f).cast("int") for f in flags), F.lit(0)).cast("boolean")).count()
        need = min(max(want - have, 0), room)
        if not need:
            continue
        free = pool.filter(flag).join(chosen.select("sample_id"), "sample_id", "left_anti").withColumn("_h", portable_hash(F.col("sample_id"), str(seed), flag))
        if vectors is not None:
            v = vectors.select(F.col("sample_id").alias("id"), "v")
            near = C.similar(v.join(free.select(F.col("sample_id").alias("id")), "id"), "id", "v", v.join(chosen.select(F.col("sample_id").alias("id")), "id"), -1.0)
            free = free.join(near.select(F.col("id").alias("sample_id"), F.col("cosine").alias("_near")), "sample_id", "left")
        else:
            free = free.withColumn("_near", F.lit(0.0))
        come = free.orderBy(F.coalesce("_near", F.lit(0.0)), "_h", "sample_id").limit(need).drop("_h", "_near")
        come = cut(come, "topup-come")
        plain = chosen.filter(~sum((F.col(f).cast("int") for f in flags), F.lit(0)).cast("boolean")).withColumn("_h", portable_hash(F.col("sample_id"), str(seed), "evict"))
        leave = plain.orderBy("_h", "sample_id").limit(come.count()).select("sample_id")
        chosen = cut(chosen.join(leave, "sample_id", "left_anti").unionByName(come.select(chosen.columns)), "topup-chosen")
    return chosen


def near_purge(pool: DataFrame, chosen: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(sample_id): unchosen rows of the pool that are nearly a chosen one of their pair."""
    v = vectors.select(F.col("sample_id").alias("id"), "v")
    out = None
    for r in chosen.select("pair").distinct().orderBy("pair").toLocalIterator():
        ref = v.join(chosen.filter(F.col("pair") == r.pair).select(F.col("sample_id").alias("id")), "id")
        rest = pool.filter(F.col("pair") == r.pair).join(chosen.select("sample_id"), "sample_id", "left_anti").select(F.col("sample_id").alias("id"))
        hit = C.similar(v.join(rest, "id"), "id", "v", ref, threshold).select(F.col("id").alias("sample_id"))
        out = hit if out is None else out.unionByName(hit)
    return chosen.select("sample_id").limit(0) if out is None else out


def reserve(corpus: DataFrame, candidates: DataFrame, policy: dict[str, Any] | None = None, vectors: DataFrame | None = None, flag_targets: dict[str, int] | None = None) -> Reservation:
    """Choose evaluation rows among *candidates* and find what of *corpus* must leave training for them.

    Both have the base columns.  vectors: (sample_id, v) of candidates, optional.
    An empty pool gives an empty reservation.
    """
    p = validated(policy)
    sel, con = p["selection"], p["contamination"]
    seed = sel["seed"]
    total = candidates.count()
    target = S.target_size(total, sel["share_percent"], sel["max_rows"])
    limit = S.candidate_limit(total, target, p["candidates"]["limit"], p["candidates"]["multiple"])
    pool = S.random_select(candidates, limit, seed)
    pool = cut(S.features(pool, tuple(p["quotas"]["length_edges"])).withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown"))), "reserve-pool")
    unique = S.dedup_exact(pool)
    links = S.minhash_links(unique, "sample_id", F.col("source_text"), F.col("pair"), p["dedup"]["minhash_threshold"], con["shingle_size"])
    kept = S.keep_unlinked(unique.select(F.col("sample_id").alias("id")), links).withColumnRenamed("id", "sample_id")
    if vectors is not None:
        pairs = pool.select(F.col("sample_id").alias("i"), "pair")
        v = vectors.join(kept, "sample_id", "left_semi").join(pairs, F.col("sample_id") == F.col("i"))
        same = S.embedding_links(v, "sample_id", "v", p["dedup"]["embedding_threshold"], F.col("pair"))
        kept = S.keep_unlinked(kept.withColumnRenamed("sample_id", "id"), same).withColumnRenamed("id", "sample_id")
    unique = cut(unique.join(kept, "sample_id", "left_semi"), "reserve-unique")
    n_unique = unique.count()
    held, holdout = held_documents(unique, corpus, p)
    unique = cut(unique.join(F.broadcast(held), ["pair", "document"], "left_semi"), "reserve-held")  # at most candidates.limit documents
    cells = {(r.pair, r.domain, r.length_bucket): r.n for r in unique.groupBy(*CELL).agg(F.count("*").alias("n")).collect()}  # one row a cell
    quotas = S.cell_quotas(cells, target, p)
    picked = diverse(unique, quotas, vectors, seed) if sel["diversity"] == "kcenter" and vectors is not None else by_quota(unique, quotas, seed)
    chosen = cut(picked, "reserve-chosen")
    chosen = top_up(unique, chosen, flag_targets or {}, seed, vectors)
    members = S.dev_test(chosen, CELL, sel["dev_share"], seed)
    verified = S.gold(chosen, ["pair", "domain"], sel["gold_size"], seed).withColumn("human_verify", F.lit(True))
    members = cut(members.join(verified, "sample_id", "left").withColumn("human_verify", F.coalesce("human_verify", F.lit(False))), "reserve-members")
    found = C.scan(corpus, chosen.select("sample_id", "source_id", "src_lang", "tgt_lang", "document_id", "source_text", "target_text"), con["comparison_scope"], con["least_shingles"])
    if vectors is not None:
        near = near_purge(unique, chosen, vectors, con["near_duplicate"]).select("sample_id", F.lit("near_duplicate").alias("reason"))
        found = found.unionByName(near.join(found.select("sample_id"), "sample_id", "left_anti"))
    found = cut(found, "reserve-quarantined")
    sizes = {r.evaluation_split: r.n for r in members.groupBy("evaluation_split").agg(F.count("*").alias("n")).collect()}
    report = {
        "policy": hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest(), "pool": total, "candidates": limit, "unique": n_unique, "holdout": holdout, "target": target, "selected": sum(sizes.values()), "splits": sizes,
        "gold": members.filter("human_verify").count(), "features": chosen.agg(*[F.count_if(f).alias(f) for f in FLAGS]).first().asDict(),
        "quarantined": {r.reason: r.n for r in found.groupBy("reason").agg(F.count("*").alias("n")).collect()},
    }
    return Reservation(members, found, report)


def reserve_dataset(corpus: DataFrame, registry: DataFrame, filters: Filters, rules: list | None = None, policy: dict[str, Any] | None = None) -> Reservation:
    """Reserve from a dataset: its trainable rows are the candidates, the whole corpus is scanned."""
    from .dataset import allocated

    return reserve(corpus, allocated(compose(corpus, filters, rules), registry), policy)


def allocation_after(registry: DataFrame, run: Reservation) -> DataFrame:
    """(sample_id, allocation) after a run: only rows that are still TRAINABLE change, reservation before quarantine."""
    to = run.members.select("sample_id", F.lit("RESERVED_EVALUATION").alias("to")).unionByName(run.quarantined.join(run.members.select("sample_id"), "sample_id", "left_anti").select("sample_id", F.lit("QUARANTINED").alias("to")))
    to = cut(to, "reserve-states")
    side: DataFrame = F.broadcast(to) if small_enough(to, 1_000_000) else to
    state: Column = F.when((F.col("allocation") == "TRAINABLE") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("allocation"))
    return registry.join(side, "sample_id", "left").select("sample_id", state.alias("allocation"))
