"""Posting keys of set joins: the rarest members of each set, complete for a given overlap.

Two sets of hashes with overlap J share a member among the n - ceil(J n) + 1
rarest of each.  Members whose posting list would be long are posted together
with further ones only, and no pair is lost:

* ``emit_keys``   posting keys of each set's rare prefix;
* ``signature``   64-bit parity bitmap; the bits in which two differ never exceed
                  the members in which the sets differ;
* ``maybe_among`` a bitmap filter before a shuffle;
* ``keyed_pairs`` the join of two posting tables; keys that still gather many
                  rows are cut into salted blocks, so that no task holds one whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..hashing import mix
from ..storage import cut, small_enough

#: From this overlap on the sets of hot members are complete.
COMPLETE_FROM = 0.75
#: Buckets of the member statistics: 2**17 longs, whatever the corpus size.
BUCKETS = 1 << 17
#: Rows that one posting key may gather before it is split by a second member.
HOT_ROWS = 1000
#: Rows of one key that a task joins at most; a key of more is cut into blocks.
BLOCK_ROWS = 4000
#: Hot keys up to this many are broadcast; more are joined.
BROADCAST_KEYS = 200_000
#: Bits of a key filter: a power of two of at least FILTER_LOAD for each key, up to 2**FILTER_MOST (16 MB).
FILTER_LOAD, FILTER_MOST = 16, 27
#: Members of the sets whose hot tails are posted by single members, pairs, triples.
TAIL_KINDS = {1: (512, 1 << 40), 2: (96, 512), 3: (0, 96)}


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row's values; wraps for unsigned integers, 0 for empty rows."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offs[1:]] - total[offs[:-1]]


def term_counts(sets: DataFrame, column: str) -> np.ndarray:
    """Rows per member bucket over the whole table; BUCKETS longs reach the driver."""
    got = sets.select(F.explode(column).alias("t")).groupBy(F.expr(f"t & {BUCKETS - 1}").alias("b")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return counts


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and starts of a list<int> column."""
    offs = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offs[0] : offs[-1]].view(np.uint32), offs - offs[0]


def by_rarity(words: np.ndarray, offs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words, rarest first (ties by hash), and their counts."""
    n = counts[words & np.uint32(BUCKETS - 1)]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((words, n, row))
    return words[order], n[order]


def per_row(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For count[r] items of each row r: the row of every item and its number within the row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def emit_keys(words: np.ndarray, counts: np.ndarray, offs: np.ndarray, p: list[np.ndarray], enough: list[np.ndarray], hot: int = HOT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys as (row, key), distinct.

    words: rarest first.  Any qualifying pair shares at least m terms among both
    rows' first p[m - 1], for m = 1, 2, 3, unless enough[m - 2] says that m - 1
    shared terms can do for this row.

    Terms of up to *hot* rows in the first prefix are keys by themselves.  Where
    that prefix also holds hot terms, all terms after it are hot as well; a pair
    that shares no rare term then shares m hot ones, so the m-subsets of the hot
    tail are keys: triples for short rows, pairs and single terms for longer
    ones, whose tails have too many triples.  Partners differ in length by at
    most 1 / COMPLETE_FROM; rows near a border between the kinds get both.
    """
    size = np.diff(offs)
    base, p = offs[:-1], [np.minimum(x, size) for x in p]
    h = mix(words.astype(np.uint64) + np.uint64(0xA5A5A5A5A5))
    row, k = per_row(p[0])
    at = base[row] + k
    rare = counts[at] <= hot
    rows, keys = [row[rare]], [h[at[rare]]]
    n_rare = np.bincount(row[rare], minlength=len(size))
    tail = n_rare < p[0]
    edge = 1 / COMPLETE_FROM
    for m in (1, 2, 3):
        lo, hi = TAIL_KINDS[m]
        does = tail & (((size > lo / edge) & (size <= hi * edge)) | (enough[m - 1] if m < 3 else False))
        length = np.where(does, p[m - 1] - n_rare, 0)
        for n in np.unique(length[length >= m]):
            which = np.flatnonzero(length == n)
            sets = np.array(list(itertools.combinations(range(n), m)))
            terms = np.sort(h[(base[which] + n_rare[which])[:, None, None] + sets[None]], axis=2)
            key = terms[:, :, 0]
            for x in range(1, m):
                key = mix(key * np.uint64(31) + terms[:, :, x])
            rows.append(np.repeat(which, len(sets)))
            keys.append(mix(key + np.uint64(m)).ravel())
    r, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, r))
    r, key = r[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (key[1:] != key[:-1])
    return r[new], key[new].view(np.int64)


def signature(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row: bit b is set if an odd number of its words falls on b."""
    bits = np.uint64(1) << (mix(words.astype(np.uint64) + np.uint64(77)) & np.uint64(63))
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)]) if len(bits) else np.zeros(1, np.uint64)
    return (total[offs[1:]] ^ total[offs[:-1]]).view(np.int64)


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The *rows* whose *column*, a hash, may be among that of *keys* (a written table): all that are, and few others.

    A bitmap by the hash's lowest bits goes to the tasks; it makes what is shuffled
    to a join on *column* smaller and changes nothing else.
    """
    shared, place = rows.sparkSession.sparkContext.broadcast(key_bitmap(keys, column)), rows.columns.index(column)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, b.column(place).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The bitmap by the lowest bits of the hashes *column* of *keys* (a written table), for ``in_bitmap``."""
    bits = 1 << min(FILTER_MOST, max(15, (FILTER_LOAD * keys.count()).bit_length()))
    at = F.expr(f"({column} & {bits - 1}L) + 1")
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # bits / 8 bytes at most
    table = np.zeros(bits // 8, np.uint8)
    for r in parts:
        table[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[:4096]
    return table


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (int64) may be among the keys of a bitmap: all that are, and few others."""
    x = hashes & (8 * len(table) - 1)
    return (table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def keyed_pairs(left: DataFrame, right: DataFrame, may: Column, name: str, block: int = BLOCK_ROWS, right_counts: DataFrame | None = None) -> DataFrame:
    """The join of two written posting tables (k, ...), aliased x and y, on k and *may*.

    Where a key has more than *block* rows on a side, that side's rows of it are
    cut into blocks by a hash of the row and every block meets every block of
    the other side: the result is the same, and no task joins more than about
    *block* x *block* rows of one key.  right_counts: (k, n) of the keys with more
    than *block* rows on the right, where they have been counted before.
    """

    def heavy(counts: DataFrame, blocks: str) -> DataFrame:
        return counts.filter(F.col("n") > block).select("k", F.ceil(F.col("n") / block).cast("int").alias(blocks))

    def counted(side: DataFrame) -> DataFrame:
        return side.groupBy("k").agg(F.count("*").alias("n"))

    of_left = heavy(counted(left), "bx")
    sides = of_left.withColumn("by", F.col("bx")) if left is right else of_left.join(heavy(counted(right) if right_counts is None else right_counts, "by"), "k", "full")
    hot = cut(sides, f"{name}-hot")
    if hot.isEmpty():
        return left.alias("x").join(right.alias("y"), (F.col("x.k") == F.col("y.k")) & may)
    hot = F.broadcast(hot) if small_enough(hot, BROADCAST_KEYS) else hot

    def salted(side: DataFrame, own: str, other: str) -> DataFrame:
        of = lambda c: F.coalesce(c, F.lit(1))
        block_of = F.pmod(F.xxhash64(*[side[c] for c in side.columns if c != "k"]), of(own)).cast("int")
        with_blocks = side.join(hot, "k", "left").withColumn(f"_{own}", block_of)
        return with_blocks.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), of(other) - 1))).drop("bx", "by")

    x, y = salted(left, "bx", "by"), salted(right, "by", "bx")
    return x.alias("x").join(y.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x._bx") == F.col("y._bx")) & (F.col("x._by") == F.col("y._by")) & may)
