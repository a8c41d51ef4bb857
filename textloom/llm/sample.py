"""A reproducible sample that stays stable while data grow: consistent weighted Poisson sampling.

A record is selected when the hash of its id lies below weight x rate.  The
choice depends on nothing else, so it is the same for every run, order and
partitioning.  Of several weights that a record was ever given the largest
counts and is what is stored, so its inclusion probability never falls and a
selected record stays selected when records, weights or batches are added.

Defined results: null ids are never selected; a null or negative weight counts
as 0, one above 1 / rate selects always; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..hashing import FINE_DIGITS, portable_hash, sql_hash


def running_weights(observed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, weight): the largest weight of each id over *observed* and what was *stored* before."""
    rows = observed.select("id", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    if stored is not None:
        rows = rows.unionByName(stored.select("id", "weight"))
    return rows.filter("id is not null").groupBy("id").agg(F.max("weight").alias("weight"))


class WeightStore:
    """Running-maximum weights kept at *path*, a table of (id, weight) that only grows.

    ``observe`` adds what a batch says of its ids and nothing else is rewritten.
    An id's weight is the largest row it has, so rows written twice, or by half
    before a crash, do no harm.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def observe(self, observed: DataFrame) -> None:
        """Store the weights of *observed* (id, weight)."""
        running_weights(observed).select(F.col("id").cast("long"), "weight").write.mode("append").parquet(self.path)

    def weights(self) -> DataFrame:
        """(id, weight): the largest weight that each id was ever given."""
        return self.spark.read.schema("id long, weight double").parquet(self.path).groupBy("id").agg(F.max("weight").alias("weight"))


def chosen(weight: Column, id_: Column, rate: float, seed: int) -> Column:
    """Whether the record is in the sample: integer hash against a scaled weight, exact in any engine."""
    return portable_hash(id_, str(seed), digits=FINE_DIGITS).cast("double") < weight * F.lit(rate * 16.0**FINE_DIGITS)


def poisson_sample(weights: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """The rows of *weights* that are in the sample."""
    return weights.filter(chosen(F.col("weight"), F.col("id"), rate, seed))


def sql_chosen(weight: str, id_: str, rate: float, seed: int = 42) -> str:
    """``chosen`` in DuckDB's dialect."""
    return f"({sql_hash(f'{id_} || {chr(39)}-{seed}{chr(39)}', FINE_DIGITS)})::DOUBLE < ({weight}) * {rate * 16.0**FINE_DIGITS!r}::DOUBLE"
