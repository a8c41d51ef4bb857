"""Reading raw uploads into DataFrames: delimited text, JSON, Parquet, TMX and XLSX."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from ..schema import union_by_name

FORMATS = ("csv", "tsv", "jsonl", "json", "parquet", "xlsx", "tmx")
# Suffixes that stand for another format.
ALIASES = {"txt": "csv", "ndjson": "jsonl", "xls": "xlsx"}


def detect_format(name: str) -> str:
    """Format by suffix; a ValueError for unknown ones."""
    suffix = posixpath.splitext(name)[1].lower().lstrip(".")
    fmt = ALIASES.get(suffix, suffix)
    if fmt not in FORMATS:
        raise ValueError(f"cannot tell the format of {name!r}")
    return fmt


def header_names(header: list[str | None]) -> list[str]:
    """Usable, different column names: empty ones become column_i, repeated ones get _2, _3, ..."""
    out: list[str] = []
    for i, h in enumerate(header, 1):
        name = (h or "").strip() or f"column_{i}"
        k, unique = 2, name
        while unique in out:
            unique, k = f"{name}_{k}", k + 1
        out.append(unique)
    return out


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union by name of Parquet files; the empty canonical relation for none."""
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else union_by_name([], spark)


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Delimited text with a header, all strings; short records are padded, long ones cut to the header."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    names = header_names(next(csv.reader([head[0][0].lstrip("﻿")], delimiter=separator), []))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, sep=separator, header=True, escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True)
    return df.filter(" or ".join(f"`{n}` is not null" for n in names))


def read_delimited_lenient(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The same by Python's csv rules, file by file, for text that Spark's reader takes differently (quotes inside
    fields, unterminated quotes).  Wider records get further columns column_n; all-empty ones are skipped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                records = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""), delimiter=separator)
                header = next(records, [])
                for i, r in enumerate(records):
                    if any(x.strip() for x in r):
                        names = header_names([*header, *[None] * (len(r) - len(header))])
                        rows.append((p, i, {n: v for n, v in zip(names, r)}))
            yield pd.DataFrame(rows, columns=["path", "row", "fields"])

    parsed = files.mapInPandas(parse, "path string, row long, fields map<string,string>")
    names = [r[0] for r in parsed.select(F.explode(F.map_keys("fields"))).distinct().collect()]  # the columns of a file
    order = header_names(next(csv.reader([spark.read.text(path).first()[0].lstrip("﻿")], delimiter=separator)))
    return parsed.select(*[F.col("fields")[n].alias(n) for n in [*order, *sorted(set(names) - set(order))]])


def _first_list(path: str, text: str) -> str | None:
    """Name of the first member of a JSON object that is a list, in the order of the document."""
    data = json.loads(text)
    return next((k for k, v in data.items() if isinstance(v, list)), None) if isinstance(data, dict) else None


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document: a list of rows, or an object whose first list is the rows; else the object is one row."""
    df = spark.read.json(path, multiLine=True)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return df
    name = lists[0]
    if len(lists) > 1:  # the schema is sorted by name; the document says which comes first
        name = spark.read.text(path, wholetext=True).rdd.map(lambda r: _first_list(path, r[0])).first() or name
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    return df.select(F.inline(name)) if isinstance(kind.elementType, T.StructType) else df.select(F.explode(name).alias("value"))


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """One row a translation unit, a column a language (lower case); inline markup is joined; the last variant wins."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        lang = "{http://www.w3.org/XML/1998/namespace}lang"
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                for i, (_, tu) in enumerate((e, x) for e, x in ElementTree.iterparse(io.BytesIO(bytes(content))) if x.tag.rsplit("}", 1)[-1] == "tu"):
                    texts = {}
                    for v in tu:
                        if v.tag.rsplit("}", 1)[-1] == "tuv":
                            seg = next((s for s in v if s.tag.rsplit("}", 1)[-1] == "seg"), None)
                            if seg is not None:
                                texts[(v.get(lang) or v.get("lang") or "und").lower()] = "".join(seg.itertext()).strip()
                    rows.append((p, i, texts))
                    tu.clear()
            yield pd.DataFrame(rows, columns=["path", "row", "texts"])

    parsed = files.mapInPandas(parse, "path string, row long, texts map<string,string>")
    langs = sorted(r[0] for r in parsed.select(F.explode(F.map_keys("texts"))).distinct().collect())  # the languages of a file
    return parsed.select(*[F.col("texts")[x].alias(x) for x in langs])


def _sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        name = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                value = c.find("m:v", ns)
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook, all strings, the first row as header."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                sheet = _sheet(bytes(content))
                names = header_names(sheet[0]) if sheet else []
                rows += [(i, {n: v for n, v in zip(names, r) if v is not None}, names) for i, r in enumerate(sheet[1:]) if any(r)]
            yield pd.DataFrame(rows, columns=["row", "fields", "names"])

    parsed = files.mapInPandas(parse, "row long, fields map<string,string>, names array<string>")
    names = parsed.select("names").first()
    return parsed.select(*[F.col("fields")[n].alias(n) for n in (names[0] if names else [])])


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format, detected from the name if not given."""
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return read_delimited(spark, path)
    if fmt == "tsv":
        return read_delimited(spark, path, "\t")
    if fmt == "jsonl":
        return spark.read.json(path)
    if fmt == "json":
        return read_json(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "xlsx":
        return read_xlsx(spark, path)
    if fmt == "tmx":
        return read_tmx(spark, path)
    raise ValueError(f"unknown format {fmt!r}")


def inspect(spark: SparkSession, path: str, fmt: str | None = None, rows: int = 5) -> tuple[list[str], list[Row]]:
    """Columns and first rows of an upload."""
    df = read_any(spark, path, fmt)
    return df.columns, df.limit(rows).collect()


def whole_lines(data: bytes) -> bytes:
    """A partial upload without its incomplete last line."""
    return data[: data.rfind(b"\n") + 1] if b"\n" in data else data


