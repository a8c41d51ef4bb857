"""Text vectors without a trained encoder: signed hashing of character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .language import nfkc
from ..storage import shared_dir


#: Bytes of text that are hashed at once, about.
SLICE = 1 << 18


def text_vectors(texts: list[str | None], dims: int = 256, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Unit vectors of the texts, a row each; zero for a text without words."""
    data = [f" {' '.join(words)} ".encode() if (words := (t or "").lower().split()) else b"" for t in texts]
    out = np.zeros((len(texts), dims), np.float32)
    size = np.array([len(x) for x in data], np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < len(texts):  # as many texts at once as have about SLICE bytes
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + SLICE, "right")))
        flat = np.frombuffer(b"".join(data[lo:hi]), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(hi - lo), size[lo:hi])
        left = np.repeat(end[lo:hi] - (end[lo] - size[lo]), size[lo:hi]) - np.arange(len(flat))  # bytes from here to the text's end
        for n in sizes:
            h = np.full(max(len(flat) - n + 1, 0), n, np.uint64)
            for k in range(n):
                h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x100000001B3)
            whole = left[: len(h)] >= n
            h = h[whole]
            h ^= h >> np.uint64(29)
            sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float32)
            at = row[: len(whole)][whole] * dims + (h % np.uint64(dims)).astype(np.int64)
            out[lo:hi] += np.bincount(at, sign, (hi - lo) * dims).reshape(-1, dims)
        lo = hi
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)  # a text without words stays the zero vector


def embedded(rows: DataFrame, id_col: str, text_col: str, dims: int = 256, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(id_col, v): unit vectors of the texts; null and empty texts have the zero vector."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "v": list(text_vectors(pdf["t"].tolist(), dims, sizes))})

    got = rows.select(F.col(id_col).cast("long").alias("id"), nfkc(F.col(text_col).cast("string")).alias("t")).mapInPandas(run, "id long, v array<float>")
    return got.withColumnRenamed("id", id_col)


def cached(rows: DataFrame, id_col: str, text_col: str, name: str, dims: int = 256) -> DataFrame:
    """The vectors from the shared folder, computed there once under *name*, the configuration and the texts they are of."""
    spark = rows.sparkSession
    of = rows.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({id_col}, {text_col}))")).first()
    path = f"{shared_dir(spark)}/embeddings/{name}-{dims}-{of[0]}-{(of[1] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
    embedded(rows, id_col, text_col, dims).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
