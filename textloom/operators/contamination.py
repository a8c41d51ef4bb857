"""Scanning the corpus for reserved rows: exact, document, shingle and vector checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import language as L
from ..functions.embedding import text_vectors
from ..hashing import mix
from ..storage import cut, forget, small_enough

#: Reference rows up to this many are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Rows and reference rows of one group that a task compares at once; larger groups are cut into such blocks.
ROW_BLOCK, REF_BLOCK = 20_000, 8_000
#: Shingles of more than this share of a block's pairs are counted by a matrix product, the others by their lists.
DENSE = 0.01


def _side(df: DataFrame) -> DataFrame:
    """*df* to be broadcast if it is short and narrow (keys and hashes); texts are never broadcast."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def shingle_hits(rows: DataFrame, row_id: str, text: Column, reference: DataFrame, ref_id: str, ref_text: Column, n: int = 3) -> DataFrame:
    """(row_id, ref_id, shared): distinct shingles that a row shares with a reference row.  Common shingles of the
    reference are many rows of one key; both sides are aggregated by hash before the join."""
    posted = rows.select(F.col(row_id), F.explode(L.shingles(L.tokens(text), n)).alias("s")).select(row_id, F.xxhash64("s").alias("s"))
    ref = reference.select(F.col(ref_id), F.explode(L.shingles(L.tokens(ref_text), n)).alias("s")).select(ref_id, F.xxhash64("s").alias("s")).distinct()
    return posted.join(_side(ref), "s").groupBy(row_id, ref_id).agg(F.count("*").alias("shared"))


def union_gate(rows: DataFrame, row_id: str, text: Column, reference: DataFrame, ref_text: Column, least: int = 2, n: int = 3) -> DataFrame:
    """(row_id, shared): rows that share at least *least* distinct shingles with the reference as a whole."""
    posted = rows.select(F.col(row_id), F.explode(L.shingles(L.tokens(text), n)).alias("s")).select(row_id, F.xxhash64("s").alias("s"))
    ref = reference.select(F.explode(L.shingles(L.tokens(ref_text), n)).alias("s")).select(F.xxhash64("s").alias("s")).distinct()
    return posted.join(_side(ref), "s").groupBy(row_id).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def same_row_gate(rows: DataFrame, row_id: str, text: Column, reference: DataFrame, ref_id: str, ref_text: Column, least: int = 2, n: int = 3) -> DataFrame:
    """(row_id, best): rows that share at least *least* shingles with one reference row, and the most shared."""
    hits = shingle_hits(rows, row_id, text, reference, ref_id, ref_text, n)
    return hits.groupBy(row_id).agg(F.max("shared").alias("best")).filter(F.col("best") >= least)


def key_shingles(keys: pa.Array, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text key (words joined by one blank), as ``language.shingles`` has them, and the row of each; repeated ones repeat."""
    keys = keys.cast(pa.large_binary())
    offs = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    blank = data == 32
    # A word starts at a row's start and after a blank, and ends before a blank and at the row's end.
    full = np.diff(offs) > 0
    start = np.sort(np.concatenate([offs[:-1][full], np.flatnonzero(blank) + 1]))
    end = np.sort(np.concatenate([offs[1:][full], np.flatnonzero(blank)]))
    inner = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    part, far = _BYTE[data] * _PLACE[inner & 255], inner > 255
    part[far] = mix(part[far] + inner[far].astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
    word = mix((total[end] - total[start]) * np.uint64(257) + (end - start).astype(np.uint64))
    row = np.searchsorted(offs, start, "right") - 1
    size = np.bincount(row, minlength=len(keys))
    first = np.cumsum(size) - size
    at = np.flatnonzero((np.arange(len(word)) - first[row] == 0) | (np.arange(len(word)) - first[row] + n <= size[row]))
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < (first + size)[row[at]]
        h = np.where(there, mix(h * np.uint64(31) + word[np.minimum(at + k, max(len(word) - 1, 0))]), h)
    return h, row[at]


_BYTE, _PLACE = (mix(np.arange(256, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1) for salt in (0x5EED, 0xB10C))


def best_shared(rows: DataFrame, refs: DataFrame, least: int, row_block: int = ROW_BLOCK, ref_block: int = REF_BLOCK) -> DataFrame:
    """(sample_id, ref, n): the reference row of its group that a row shares most shingles with, the smallest of equals, if at least *least*.

    rows: (sample_id, g, key), refs: (ref, g, key), of written tables, with the text keys.  Blocks of a group's rows meet
    blocks of its reference rows in one task each; the pairs are counted there, and only a row's best one leaves it.
    """
    sizes = refs.groupBy("g").agg(F.ceil(F.countDistinct("ref") / ref_block).cast("int").alias("nr"))
    sizes = sizes.join(rows.groupBy("g").agg(F.ceil(F.count("*") / row_block).cast("int").alias("nx")), "g")
    sizes = cut(sizes, "scan-blocks")
    sizes = F.broadcast(sizes) if small_enough(sizes, BROADCAST_ROWS) else sizes

    def placed(side: DataFrame, own: str, other: str, id_col: str) -> DataFrame:
        with_block = side.join(sizes, "g").withColumn(f"_{own}", F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))
        return with_block.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("g", "_nx", "_nr", id_col, "key")

    def cell(x: pa.Table, r: pa.Table) -> pa.Table:
        none = pa.table({"sample_id": pa.array([], pa.int64()), "ref": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        if not (x.num_rows and r.num_rows):
            return none
        (ids, xs, row), (ref, rs, ref_row) = ((t.column(3).to_numpy(), *key_shingles(pa.concat_arrays([c.cast(pa.large_string()) for c in t.column(4).chunks]))) for t in (x, r))
        ref, ref_of = np.unique(ref, return_inverse=True)
        known, at = np.unique(rs, return_inverse=True)
        post = np.unique(at * len(ref) + ref_of[ref_row])  # by shingle, then by reference row
        who = post % len(ref)
        first = np.searchsorted(post, np.arange(len(known) + 1) * len(ref))
        held = np.diff(first)
        got = np.searchsorted(known, xs)
        got[got == len(known)] = 0
        hit = known[got] == xs
        once = np.unique(row[hit] * len(known) + got[hit])  # by row; a shingle counts once
        row, got = once // len(known), once % len(known)
        hot = np.bincount(got, minlength=len(known)) * held > DENSE * len(ids) * len(ref)
        column = np.cumsum(hot) - 1
        dense = np.zeros((int(hot.sum()), len(ref)), np.float32)
        of = np.repeat(np.arange(len(known)), held)
        dense[column[of[hot[of]]], who[hot[of]]] = 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 21) // len(ref))
        keep = np.flatnonzero(np.bincount(row, minlength=len(ids)) >= least)
        place = np.full(len(ids), -1)
        place[keep] = np.arange(len(keep))
        got, row = got[place[row] >= 0], place[row[place[row] >= 0]]
        for lo in range(0, len(keep), step):
            a, b = np.searchsorted(row, (lo, lo + step))
            s, k, n = got[a:b], row[a:b] - lo, min(step, len(keep) - lo)
            some = np.zeros((n, len(dense)), np.float32)
            some[k[hot[s]], column[s[hot[s]]]] = 1
            shared = some @ dense if len(dense) else np.zeros((n, len(ref)), np.float32)
            s, k = s[~hot[s]], k[~hot[s]]
            if len(s):
                length = held[s]
                item = np.repeat(first[s] - np.cumsum(length) + length, length) + np.arange(length.sum())
                np.add.at(shared.reshape(-1), np.repeat(k, length) * len(ref) + who[item], np.float32(1))
            best = shared.argmax(1)  # reference rows ascend: the smallest of equals
            n = shared[np.arange(n), best]
            ok = n >= least
            out.append((ids[keep[lo : lo + step]][ok], ref[best[ok]], n[ok].astype(np.int32)))
        return pa.table(dict(zip(("sample_id", "ref", "n"), map(np.concatenate, zip(*out))))) if out else none

    keys = ["g", "_nx", "_nr"]
    met = placed(rows, "nx", "nr", "sample_id").groupBy(*keys).cogroup(placed(refs, "nr", "nx", "ref").groupBy(*keys)).applyInArrow(cell, "sample_id long, ref long, n int")
    return met.groupBy("sample_id").agg(F.max_by(F.struct("ref", "n"), F.struct("n", -F.col("ref"))).alias("x")).select("sample_id", "x.ref", "x.n")


def near_texts(pairs: DataFrame, threshold: float) -> DataFrame:
    """(sample_id, cosine) of the pairs (sample_id, a, b) whose texts' hashed n-gram vectors reach the cosine."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                p = pdf.iloc[lo : lo + 1000]
                of, texts = pd.factorize(p["b"].fillna(""))  # a reference row is often the best of many
                got = (text_vectors(p["a"].tolist()) * text_vectors(texts.tolist())[of]).sum(1)
                ok = got >= threshold
                yield pd.DataFrame({"sample_id": p["sample_id"].to_numpy()[ok], "cosine": got[ok].astype(float)})

    return pairs.select("sample_id", L.nfkc(F.col("a")).alias("a"), L.nfkc(F.col("b")).alias("b")).mapInPandas(run, "sample_id long, cosine double")


def scan(rows: DataFrame, reserved: DataFrame, scope: str = "pair", least: int | None = 2, key=L.text_key, cosine: bool = True) -> DataFrame:
    """(sample_id, reason) of the rows to quarantine for *reserved*, the first reason that holds:

    exact target (any group), exact source or held document (in the row's group), near source, else near target: of a
    row that shares *least* shingles with one reserved row of the group (not at all if None), the cosine with the one
    that it shares most with reaches the scope's threshold (``cosine=False``: the shingles decide).  Selected rows are skipped.
    """
    sides = ("source_text", "target_text")

    def with_keys(df: DataFrame) -> DataFrame:
        """The texts with their text keys, made once."""
        return df.select("sample_id", "_g", "_doc", *sides, *[L.text_key(F.col(c)).alias(f"_{c}") for c in sides])

    reserved = cut(reserved.select("sample_id", "source_id", "src_lang", "tgt_lang", "document_id", "source_text", "target_text"), "scan-reserved")
    keyed = rows.join(_side(reserved.select("sample_id").distinct()), "sample_id", "left_anti").withColumn("_g", L.comparison_group(scope, F.col("src_lang"), F.col("tgt_lang")))
    keyed = keyed.withColumn("_doc", L.document_key(F.col("document_id"), F.col("sample_id"), F.col("source_id")))
    keyed = cut(with_keys(keyed), "scan-rows")
    ref = reserved.withColumn("_g", L.comparison_group(scope, F.col("src_lang"), F.col("tgt_lang"))).withColumn("_doc", L.document_key(F.col("document_id"), F.col("sample_id"), F.col("source_id")))
    ref = cut(with_keys(ref), "scan-references")
    forget(reserved)

    def semi(name: str, rank: int, *by: Column) -> DataFrame:
        """Rows with the values of a reserved one; values meet by 96 bits of hashes."""
        some = F.lit(True)
        for v in by:
            some = some & v.isNotNull() & (v != "")
        of = lambda t, *more: t.filter(some).select(*more, F.xxhash64(*by).alias("a"), F.hash(*by).alias("b"))
        return of(keyed, "sample_id").join(_side(of(ref).distinct()), ["a", "b"], "left_semi").select("sample_id", F.lit(rank).alias("rank"), F.lit(name).alias("reason"))

    k = lambda c: F.col(f"_{c}") if key is L.text_key else key(F.col(c))
    found = semi("exact_target", 1, k("target_text")).unionByName(semi("exact_source", 2, F.col("_g"), k("source_text"))).unionByName(semi("held_document", 3, F.col("_g"), F.col("_doc")))
    for rank, side in ((4, "source"), (5, "target")) if least is not None else ():
        c = f"{side}_text"
        keys = lambda t, i: t.select(F.col("sample_id").cast("long").alias(i), F.col("_g").alias("g"), F.col(f"_{c}").alias("key")).filter("key <> ''")  # noqa: B023, E731
        hits = cut(best_shared(keys(keyed, "sample_id"), keys(ref, "ref"), least), "scan-best")
        if cosine:
            pairs = hits.select("sample_id", "ref").join(keyed.select("sample_id", F.col(c).alias("a")), "sample_id").join(ref.select(F.col("sample_id").alias("ref"), F.col(c).alias("b")), "ref")
            best, hits = hits, cut(near_texts(pairs, L.cosine_thresholds(scope)[side]), "scan-near")
            forget(best)
        found = found.unionByName(hits.select("sample_id", F.lit(rank).alias("rank"), F.lit(f"{'near' if cosine else 'shingles'}_{side}").alias("reason")).distinct())
    return found.groupBy("sample_id").agg(F.min_by("reason", "rank").alias("reason"))


def similar(vectors: DataFrame, id_col: str, vector_col: str, reference: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, ref_id, cosine): each vector with its nearest reference vector, where that reaches the threshold.

    The reference is a stated set; it goes to the tasks in blocks of at most
    BROADCAST_ROWS rows, each compared by one matrix product per batch.
    """
    spark = vectors.sparkSession
    out = None
    rows = reference.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).orderBy("id")
    block_rows, pending = 50_000, []

    def one(part: list) -> DataFrame:
        ids, m = np.array([r[0] for r in part]), np.array([r[1] for r in part], float)
        m /= np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, norm)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches):
            ids, m = shared.value
            for pdf in batches:
                for lo in range(0, len(pdf), block):
                    p = pdf.iloc[lo : lo + block]
                    v = np.stack(p["v"].to_numpy()).astype(float)
                    v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
                    s = v @ m.T
                    s[p["id"].to_numpy()[:, None] == ids[None, :]] = -2  # not with itself
                    at = s.argmax(1)
                    best = s[np.arange(len(p)), at]
                    ok = best >= threshold
                    yield pd.DataFrame({"id": p["id"].to_numpy()[ok], "ref_id": ids[at[ok]], "cosine": best[ok]})

        return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null").mapInPandas(run, "id long, ref_id long, cosine double")

    for r in rows.toLocalIterator():
        pending.append(r)
        if len(pending) == block_rows:
            out = one(pending) if out is None else out.unionByName(one(pending))
            pending = []
    if pending:
        out = one(pending) if out is None else out.unionByName(one(pending))
    if out is None:
        return spark.createDataFrame([], "id long, ref_id long, cosine double")
    return out.groupBy("id").agg(F.max_by("ref_id", F.struct("cosine", -F.col("ref_id"))).alias("ref_id"), F.max("cosine").alias("cosine"))
