"""Readers and writers by file type, and the normalising of what they give."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Share of non-null texts that must be numbers (dates) for a column to become one.
NUMBERS, DATES = 0.98, 0.95
NUMBER = r"^\s*-?\d+(\.\d+)?\s*$"
DATE_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy")
SUFFIXES = (".csv", ".txt", ".tsv", ".json", ".parquet", ".xlsx")


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of a text table, from its first lines."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
    try:
        return csv.Sniffer().sniff(head, delimiters=",;|\t").delimiter
    except csv.Error:
        return ","


def load(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table from a file or folder, by its suffix, normalised. Parquet keeps its pushdown: it is only renamed."""
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type {suffix!r}; supported: {', '.join(SUFFIXES)}")
    if suffix == ".parquet":
        return nan_to_null(rename(spark.read.parquet(path)))
    if suffix == ".xlsx":
        sheets = load_sheets(spark, path)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}")
        return sheets[sheet] if sheet else max(sheets.values(), key=lambda d: (len(d.columns), d.count()))
    if suffix == ".json":
        d = spark.read.json(path, multiLine=True)
    else:
        sep = "\t" if suffix == ".tsv" else sniff(spark, path)
        d = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    if not d.columns:
        raise ValueError("the file is empty")
    return normalise(d)


def unique_names(given: list[str]) -> list[str]:
    """Trimmed names; blank ones become Unnamed; repeated ones get _1, _2."""
    names, seen = [], {}
    for c in given:
        name = c.strip() or "Unnamed"
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}_{n}" if n else name)
    return names


def rename(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means no value, as null does."""
    real = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else df


def date_of(c: str):
    return F.coalesce(*[F.try_to_timestamp(F.trim(F.col(c)), F.lit(p)) for p in DATE_PATTERNS]).cast("timestamp_ntz")


def normalise(df: DataFrame) -> DataFrame:
    """Names set right, empty rows dropped, texts that are numbers or dates cast. One pass decides for all columns."""
    d = rename(df)
    d = d.na.drop(how="all")
    texts = [n for n, t in d.dtypes if t == "string"]
    if texts:
        plain = lambda c: F.regexp_replace(F.col(c), ",", "")
        facts = d.agg(*[x for i, c in enumerate(texts) for x in (F.count(c).alias(f"n{i}"), F.count_if(plain(c).rlike(NUMBER)).alias(f"k{i}"), F.count(date_of(c)).alias(f"d{i}"), F.count_if(F.year(date_of(c)).between(1800, 2200)).alias(f"y{i}"))]).first()
        casts = {}
        for i, c in enumerate(texts):
            n = facts[f"n{i}"]
            if n and facts[f"k{i}"] >= NUMBERS * n:
                casts[c] = F.expr(f"try_cast(trim(regexp_replace(`{c}`, ',', '')) as double)")
            elif n and facts[f"d{i}"] >= DATES * n and facts[f"y{i}"] >= DATES * facts[f"d{i}"]:
                casts[c] = date_of(c)
        d = d.withColumns(casts) if casts else d
    return nan_to_null(d)


def load_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sheets of an .xlsx file (an archive of XML, read through Spark's binary reader)."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        for i, name in enumerate(names, 1):
            rows = []
            for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{ns['m']}}}row"):
                row: dict[int, str | None] = {}
                for c in r.findall("m:c", ns):
                    letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    v = c.find("m:v", ns)
                    text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or None
                    row[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append(row)
            if not rows:
                continue
            width = max(max(r, default=-1) for r in rows) + 1
            head = [rows[0].get(k) or "" for k in range(width)]
            data = [[r.get(k) for k in range(width)] for r in rows[1:]]
            d = spark.createDataFrame(data, ", ".join(f"c{k} string" for k in range(width)))
            out[name] = normalise(d.toDF(*unique_names(head)))
    return out


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes a result as parquet, csv or json."""
    w = df.write.mode(mode)
    {"parquet": w.parquet, "csv": lambda p: w.csv(p, header=True), "json": w.json}[kind](path)


def page(df: DataFrame, limit: int = 200, offset: int = 0) -> dict:
    """One page of a result, safe for JSON: {columns, rows, total_rows}."""

    def plain(v):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        return v.isoformat() if hasattr(v, "isoformat") else v

    rows = df.offset(offset).limit(limit).collect()
    return {"columns": df.columns, "rows": [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows], "total_rows": df.count()}
