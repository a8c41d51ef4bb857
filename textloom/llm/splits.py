"""Splits that keep related records together.

Records that share a key (a document, author, source, entity) belong to one
component; components, not records, are assigned to splits.

``components`` runs hash-to-min over the keys: every key holds a cluster (at
first itself and its neighbours), sends the whole cluster to the cluster's
minimum and the minimum to all others, until nothing changes.  Clusters are
rows, never collected lists, so that a giant component stays spread over tasks;
records that share the same keys are one link.

``assign`` draws the split of a component by weighted rendezvous hashing: split s
scores -w(s) / ln(u(component, s)), the highest score wins.  Proportions hold in
expectation over components, no state is kept, and changing one weight moves
only the components that this split gains or loses.

Defined results: a record without keys (null or empty list, null keys) is a
component of its own; repeated records get the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..hashing import unit_hash
from ..storage import cut, forget

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
# How a piece of a document is marked behind its base name.
PIECE = r"(\s+part\s+[0-9]+|[:#/|]\s*(chunk|part|p\.|c)?\s*[0-9]+)$"


def document_name(document_id: Column) -> Column:
    """Base name in lower case, without blanks around and without the mark of the piece; null if blank."""
    name = F.regexp_replace(F.lower(document_id), r"^\s+|\s+$", "")
    base = F.regexp_replace(F.regexp_replace(name, PIECE, ""), r"\s+$", "")
    return F.when(base != "", base)


def hash_to_min(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): component is the least node reachable."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    itself = both.select("a").distinct().select("a", F.col("a").alias("b"))
    clusters, before = cut(both.unionByName(itself).distinct(), "p2-clusters"), None
    while True:
        state = clusters.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
        least = clusters.groupBy("a").agg(F.min("b").alias("m"))
        sent = clusters.join(least, "a")
        to_least = sent.select(F.col("m").alias("a"), "b")
        to_all = sent.select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, clusters = clusters, cut(to_least.unionByName(to_all).distinct(), "p2-clusters")
        forget(old)
    return clusters.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def components(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """*records* with a string column component; *keys* are string columns, null where a record has none.

    A record's first key stands for it; its other keys are links of the first.
    """
    listed = records.withColumn("_keys", F.array_compact(F.array(*keys)))
    first, alone = F.get("_keys", F.lit(0)), F.concat(F.lit("record "), F.col(id_col).cast("string"))
    links = listed.filter(F.size("_keys") > 1).select(first.alias("a"), F.explode(F.slice("_keys", 2, len(keys))).alias("b")).filter("a <> b").distinct()
    found = hash_to_min(links)
    joined = listed.withColumn("_key", F.coalesce(first, alone)).join(found.withColumnRenamed("node", "_key"), "_key", "left")
    return joined.withColumn("component", F.coalesce("component", "_key")).drop("_key", "_keys")


def assign(component: Column, proportions: dict[str, float] = PROPORTIONS, seed: int = 42) -> Column:
    """The split of a component."""
    scores = [F.struct((-F.lit(float(w)) / F.log(unit_hash(component, str(seed), name))).alias("score"), F.lit(name).alias("name")) for name, w in proportions.items() if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["name"]


def torn(members: DataFrame, split_col: str, key_cols: list[str]) -> DataFrame:
    """Components whose members carry two or more of the different values of *split_col* (nulls count for none)."""
    return members.filter(F.col(split_col).isNotNull()).groupBy("component", *key_cols).agg(F.min(split_col).alias("_least"), F.max(split_col).alias("_most")).filter("_least <> _most").drop("_least", "_most")
