"""Near-same records: word sets, posting keys and exact verification.

Two records are near-same when the distinct folded words of both their sides
overlap to at least ``THRESHOLD`` (words in both / words in either).  This
module holds what the cross-split join (``overlap``) and the history index
(``history``) share:

* ``word_sets``   record -> sets of 32-bit word hashes per side, plus a class
                  hash that is equal for records written alike;
* ``may_match``   length and bitmap filter inside the join of posting keys
                  (``functions.postings``); it drops no related pair;
* ``verify``      exact overlap of the surviving pairs.

Nulls, empty texts and texts without letters or digits have no words and are
near-same to nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textblock as tb
from ..functions.postings import BUCKETS, by_rarity, emit_keys, keyed_pairs, lists, maybe_among, per_row, row_sums, signature, term_counts  # noqa: F401
from ..storage import small_enough

THRESHOLD = 0.75
#: Ids up to this many are broadcast to thin a table before its shuffle; above, it is shuffled.
BROADCAST_IDS = 200_000

SET_SCHEMA = "id long, c long, sw array<int>, tw array<int>"
_M32 = np.uint64(0xFFFFFFFF)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit word hashes of each text, ascending, and their starts."""
    h, first = tb.hashed_words(texts)
    n = len(first) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = np.unique((row << np.uint64(32)) | (h.view(np.uint64) & _M32))
    words = (key & _M32).astype(np.uint32)
    return words, np.searchsorted(key >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def class_hash(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set, whatever its order."""
    return tb.mix(row_sums(tb.mix(words.astype(np.uint64) + np.uint64(0x51ED27)), offs) + np.diff(offs).astype(np.uint64))


def word_sets(df: DataFrame, id_col: str, source_col: str, target_col: str) -> DataFrame:
    """(id, c, sw, tw) of each record; records without words on either side are left out."""

    def run(batches):
        for b in batches:
            sw, so = distinct_words(b.column(1))
            tw, to = distinct_words(b.column(2))
            c = tb.mix(class_hash(sw, so) * np.uint64(3) + class_hash(tw, to)).view(np.int64)
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(c), tb.list_array(sw.view(np.int32), so, pa.int32()), tb.list_array(tw.view(np.int32), to, pa.int32())], ["id", "c", "sw", "tw"]
            )
            yield out.filter(pa.array((np.diff(so) > 0) & (np.diff(to) > 0)))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string"), F.col(target_col).cast("string")).filter("id is not null").mapInArrow(run, SET_SCHEMA)


POSTING_SCHEMA = "k long, c long, n int, bs long, bt long"


def posting_batch(c: pa.Array, rows: np.ndarray, keys: np.ndarray, sw, so, tw, to) -> pa.RecordBatch:
    """Postings with what the join needs to drop a pair: both set sizes (in n) and both bitmaps."""
    n = (np.minimum(np.diff(so), 32767) | (np.minimum(np.diff(to), 32767) << 16)).astype(np.int32)
    take = pa.array(rows)
    cols = [pa.array(keys), c.take(take), *(pa.array(x).take(take) for x in (n, signature(sw, so), signature(tw, to)))]
    return pa.RecordBatch.from_arrays(cols, ["k", "c", "n", "bs", "bt"])


def may_match(a: str, b: str) -> Column:
    """Length and bitmap filter of two postings; true for every near-same pair."""

    def side(n: str, bits: str) -> str:
        x, y = n.format(a), n.format(b)
        close = f"least({x}, {y}) >= {THRESHOLD} * greatest({x}, {y}) or greatest({x}, {y}) = 32767"
        few = f"bit_count({a}.{bits} ^ {b}.{bits}) <= ({x} + {y}) * {(1 - THRESHOLD) / (1 + THRESHOLD)} + 1e-9 or greatest({x}, {y}) = 32767"
        return f"({close}) and ({few})"

    return F.expr(f"{side('({}.n & 32767)', 'bs')} and {side('(({}.n >> 16) & 32767)', 'bt')}")


#: Slices of the key space, and postings a class of a pass: what is written and shuffled at once.
SLICES, PASS_POSTINGS = 16, 8


def in_slices(postings: DataFrame, lo: int, hi: int) -> DataFrame:
    """The postings of slices lo to hi - 1 of the key space."""
    return postings if (lo, hi) == (0, SLICES) else postings.filter(f"pmod(hash(k), {SLICES}) between {lo} and {hi - 1}")


def passes(run, classes: int, slices: int = SLICES, a_class: int = PASS_POSTINGS) -> list[DataFrame]:
    """The results of run(lo, hi), which also tells how many postings slices lo to hi - 1 have, over all slices.

    Every key falls into one slice, so all results together are those of one run
    over all keys.  The first slice tells how many of the others may go at once
    without more than *a_class* postings for each class.
    """
    found, n = run(0, 1)
    out, lo = [found], 1
    step = max(1, min(slices, classes * a_class // max(n, 1)))
    while lo < slices:
        hi = min(lo + step, slices)
        out.append(run(lo, hi)[0])
        lo = hi
    return out


def thinned(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of *table* with a (c, id) of *keys* (a written table); few keys are broadcast, many are joined."""
    return table.join(F.broadcast(keys) if small_enough(keys, BROADCAST_IDS) else keys, ["c", "id"], "left_semi")


def verify(pairs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """Class pairs (a, b) with the exact overlaps js, jt of both sides, those of at least THRESHOLD.

    keys: (c, id), one record for each class that occurs in pairs.
    """
    s = thinned(sets, keys).select("c", "sw", "tw").dropDuplicates(["c"])
    left, right = s.select(F.col("c").alias("a"), F.col("sw").alias("sa"), F.col("tw").alias("ta")), s.select(F.col("c").alias("b"), F.col("sw").alias("sb"), F.col("tw").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    for x in "st":
        i = F.size(F.array_intersect(f"{x}a", f"{x}b"))
        both = both.withColumn(f"j{x}", i / (F.size(f"{x}a") + F.size(f"{x}b") - i))
    return both.filter((F.col("js") >= THRESHOLD) & (F.col("jt") >= THRESHOLD))


def class_sets(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """The sets of the representatives alone, with the columns of *reps* (a written table: c, id, ...); one that is stored twice is so still."""
    return sets.join(F.broadcast(reps) if small_enough(reps, BROADCAST_IDS) else reps, ["c", "id"])


def classes(sets: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records written alike as one class.

    sides: (id, in_a, in_b).  Returns members (c, id, in_a, in_b) of the records
    on either side and classes (c, id, in_a, in_b) with the smallest record as
    representative and whether the class has members on each side.
    """
    members = sets.select("c", "id").distinct().join(sides.filter("in_a or in_b"), "id").select("c", "id", "in_a", "in_b")
    return members, members.groupBy("c").agg(F.min("id").alias("id"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def expand(pairs: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """Record pairs of the class pairs (a, b), and of the classes that are on both sides."""
    within = reps.filter("in_a and in_b").select(F.col("c").alias("a"), F.col("c").alias("b"))
    a = members.filter("in_a").select(F.col("c").alias("a"), F.col("id").alias("id_a"))
    b = members.filter("in_b").select(F.col("c").alias("b"), F.col("id").alias("id_b"))
    return pairs.select("a", "b").unionByName(within).distinct().join(a, "a").join(b, "b").filter("id_a <> id_b").select("id_a", "id_b")
