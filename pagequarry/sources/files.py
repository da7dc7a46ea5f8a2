"""Messy organisation exports: rows of cells from CSV in any of four encodings and from XLSX.

`spark.read.csv` takes the number of columns from the first row and knows no windows-1252, so short
metadata rows above the header would cost cells; these Python data sources keep every row as it is.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
ROWS = "path string, row_no int, cells array<string>"


def csv_rows(raw: bytes) -> list[list[str]]:
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    return list(csv.reader(io.StringIO(text, newline="")))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_rows(raw: bytes) -> list[list[str]]:
    """The values of the active sheet. A numeric 0 is an empty cell, as the importer treats it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")
        view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
        active = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == active.get(_REL))
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.iter(f"{_MAIN}row"):
        cells: list[str] = []
        for c in row.findall(f"{_MAIN}c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            cells[at] = _cell(c, shared)
        rows.append(cells)
    return rows


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(c, shared: list[str]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    v = c.find(f"{_MAIN}v")
    text = "" if v is None else v.text or ""
    if kind == "s":
        return shared[int(text)]
    if kind == "n" and text:
        number = float(text)
        if number == 0:
            return ""
        return str(int(number)) if number == int(number) else text
    return text


READERS = {".csv": csv_rows, ".xlsx": xlsx_rows, ".xls": xlsx_rows}


def reader_for(path: str):
    suffix = re.search(r"(\.[^./]*)?$", path)[0].lower()
    if suffix not in READERS:
        raise ValueError(f"Unsupported source file type: {suffix or path}")
    return READERS[suffix]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            rows = reader_for(partition.path)(f.read())
        for i, cells in enumerate(rows):
            yield partition.path, i, [str(c) for c in cells]


class RawRows(DataSource):
    """spark.read.format("raw_rows").load(path): one row per line or sheet row."""

    @classmethod
    def name(cls) -> str:
        return "raw_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema):
        return _Reader([p for p in self.options["path"].split(",") if p])


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    reader_for(path)
    spark.dataSource.register(RawRows)
    return spark.read.format("raw_rows").load(path)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def rows_of(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([[[str(c) for c in r] for r in reader_for(p)(bytes(x))] for p, x in zip(path, content)])


def raw_rows_remote(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for files that only Spark can open: one task per file, small files only."""
    files = spark.read.format("binaryFile").load(path)
    each = files.select("path", F.posexplode(rows_of("path", "content")).alias("row_no", "cells"))
    return each.select("path", F.col("row_no").cast("int"), "cells")


def newest_source(spark: SparkSession, folder: str) -> str | None:
    """The newest csv, xlsx or xls of a folder; names in lower case break ties, the last first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,xlsx,xls,CSV,XLSX,XLS}").load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    first = files.select("path", "modificationTime", name.alias("n")).orderBy(F.desc("modificationTime"), F.desc("n")).first()
    return first["path"] if first else None
