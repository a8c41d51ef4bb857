"""Writing: shards of bounded size, checksums, snapshots, exports."""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dataset import split_of

SHARD_BYTES = 256 * 1024 * 1024


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files below *path* with their sizes, by name."""
    p, fs = _fs(spark, path)
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        if not s.getPath().getName().startswith(("_", ".")):
            out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def write_shards(df: DataFrame, path: str, most_bytes: int = SHARD_BYTES) -> list[tuple[str, int]]:
    """zstd Parquet shards of at most *most_bytes* each.

    Rows per file are estimated from a first write; where a shard still is too
    large the rows per file are halved and it is written again.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = files(spark, path)
    per_file = None
    while any(size > most_bytes for _, size in written):
        if per_file is None:
            rows, total = df.count(), sum(s for _, s in written)
            per_file = max(1, int(rows * most_bytes / total * 0.8))
        else:
            per_file = max(1, per_file // 2)
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
        written = files(spark, path)
        if per_file == 1:
            break
    return written


def checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file, computed where the files are read."""
    def digest(batches):
        for pdf in batches:
            yield pdf.assign(sha=[hashlib.sha256(bytes(c)).hexdigest() for c in pdf["content"]])[["path", "sha"]]

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").filter("not element_at(split(path, '/'), -1) rlike '^[_.]'")
    return {r.path.rsplit("/", 1)[-1]: r.sha for r in rows.mapInPandas(digest, "path string, sha string").collect()}  # one row a shard


def publish(df: DataFrame, base: str, batch_id: int, attempt: str) -> str:
    """Write a batch under a new attempt; the caller sets the batch's pointer to what is returned once it is whole."""
    path = f"{base.rstrip('/')}/batches/batch_{batch_id}/attempt_{attempt}"
    write_shards(df, path)
    return path


def delete_prefix(spark: SparkSession, root: str, prefix: str) -> int:
    """Delete the files below root/prefix and return how many; never the root, never outside, never a sibling prefix."""
    parts = [p for p in prefix.strip("/").split("/") if p]
    if not parts or ".." in parts:
        raise ValueError(f"refused to delete {prefix!r}")
    target = f"{root.rstrip('/')}/{'/'.join(parts)}"
    p, fs = _fs(spark, target)
    if not fs.exists(p):
        return 0
    n = len(files(spark, target))
    fs.delete(p, True)
    return n


def write_snapshot(rows: DataFrame, path: str, definition: dict, ratios: dict[str, float] | None = None, seed: int = 42) -> dict:
    """Train, validation and test in one pass (partitioned by split), and a manifest with counts from what was written."""
    rows.withColumn("split", split_of(F.col("sample_id"), ratios, seed)).write.mode("errorifexists").option("compression", "zstd").partitionBy("split").parquet(path)
    spark = rows.sparkSession
    counts = {r.split: r.n for r in spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n")).collect()}
    manifest = {
        "definition": definition, "seed": seed, "ratios": ratios, "counts": {s: counts.get(s, 0) for s in ("train", "validation", "test")},
        "total": sum(counts.values()), "files": [{"path": p.split(path.rstrip("/"))[-1], "bytes": n} for p, n in files(spark, path)],
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}_manifest", wholetext=True).first()[0])


def selected(value: str | None, allowed: list[str], label: str) -> list[str]:
    """A comma-separated choice, in the order of *allowed*; all for none; unknown names are an error."""
    names = [v.strip() for v in (value or "").split(",") if v.strip()]
    unknown = sorted(set(names) - set(allowed))
    if unknown:
        raise ValueError(f"unknown {label}: {', '.join(unknown)}")
    return [a for a in allowed if a in names] if names else list(allowed)


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name).strip("-.") or "export"


def export(df: DataFrame, path: str, fmt: str, columns: list[str]) -> None:
    """Selected columns as parquet, csv, tsv or jsonl."""
    out = df.select(*columns).write.mode("overwrite")
    if fmt == "parquet":
        out.option("compression", "zstd").parquet(path)
    elif fmt in ("csv", "tsv"):
        out.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').csv(path)
    elif fmt == "jsonl":
        out.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def export_package(splits: dict[str, DataFrame], path: str, title: str, columns: list[str], rows_per_file: int = 5_000_000) -> list[str]:
    """A data package: data/<split>-0000i-of-0000n.parquet and a dataset card; files of at most *rows_per_file* rows."""
    names = []
    spark = next(iter(splits.values())).sparkSession
    for split, df in splits.items():
        n = max(1, math.ceil(df.count() / rows_per_file))
        part = f"{path.rstrip('/')}/_{split}"
        df.select(*columns).repartition(n).write.mode("overwrite").parquet(part)
        for i, (f, _) in enumerate(files(spark, part)):
            target = f"{path.rstrip('/')}/data/{split}-{i:05d}-of-{n:05d}.parquet"
            t, fs = _fs(spark, target)
            fs.mkdirs(t.getParent())
            fs.rename(_fs(spark, f)[0], t)
            names.append(target)
        p, fs = _fs(spark, part)
        fs.delete(p, True)
    return names


def dataset_card(title: str, languages: list[str], splits: dict[str, int]) -> str:
    """Text of the card of a package."""
    lines = ["---", "language:", *[f"- {x}" for x in languages], "configs:", "- config_name: default", "  data_files:"]
    for s in splits:
        lines += [f"  - split: {s}", f"    path: data/{s}-*.parquet"]
    return "\n".join([*lines, "---", "", f"# {title}", "", *[f"- {s}: {n} rows" for s, n in splits.items()], ""])


def zipped(contents: dict[str, bytes]) -> bytes:
    """A ZIP of small files (manifest, card, export.json)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(contents.items()):
            z.writestr(name, data)
    return out.getvalue()
