"""Readers for delimited files, workbooks and Spark's own formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.sources.typing import infer_types, normalize, without_missing_tokens

FORMATS = ("csv", "xlsx", "parquet", "json", "orc")


def load_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Delimited text with a header row; types are inferred from all rows.

    ``multiline=False`` lets Spark split large files; use it when no quoted cell holds a line break.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"')
    return infer_types(without_missing_tokens(text))


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the first sheet of each workbook, in slices of a few thousand rows.

    A workbook is a zip of XML parts and holds at most 1,048,576 rows by format.
    """
    import io
    import re
    import zipfile
    from datetime import datetime, timedelta
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def texts(node) -> str:
        return "".join(t.text or "" for t in node.iter(main + "t"))

    def first_sheet(book: zipfile.ZipFile) -> str:
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{main}sheets/{main}sheet")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(relation))
        return target.lstrip("/") if target.startswith("/") else "xl/" + target

    def date_styles(book: zipfile.ZipFile) -> set[int]:
        if "xl/styles.xml" not in book.namelist():
            return set()
        root = ElementTree.fromstring(book.read("xl/styles.xml"))
        # The built-in number formats that show a date or a time.
        dated = {*range(14, 23), *range(45, 48)}
        for form in root.iter(main + "numFmt"):
            if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", form.get("formatCode", "").lower())):
                dated.add(int(form.get("numFmtId")))
        cells = root.find(main + "cellXfs")
        return {i for i, xf in enumerate(cells if cells is not None else ()) if int(xf.get("numFmtId", 0)) in dated}

    def column_number(reference: str) -> int:
        number = 0
        for letter in re.match(r"[A-Z]+", reference).group():
            number = number * 26 + ord(letter) - 64
        return number - 1

    def cell_text(cell, shared: list[str], dated: set[int]):
        kind, value = cell.get("t"), cell.find(main + "v")
        if kind == "inlineStr":
            return texts(cell)
        if value is None or value.text is None:
            return None
        if kind == "s":
            return shared[int(value.text)]
        if kind == "b":
            return "True" if value.text == "1" else "False"
        if kind == "e":
            return None
        if kind is None and int(cell.get("s", 0)) in dated:
            return (datetime(1899, 12, 30) + timedelta(days=float(value.text))).isoformat(sep=" ", timespec="seconds")
        return value.text

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = [texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                dated = date_styles(book)
                slice_, index = [], 0
                with book.open(first_sheet(book)) as sheet:
                    for _, row in ElementTree.iterparse(sheet):
                        if row.tag != main + "row":
                            continue
                        values: list = []
                        for place, cell in enumerate(row.iter(main + "c")):
                            at = column_number(cell.get("r")) if cell.get("r") else place
                            values += [None] * (at + 1 - len(values))
                            values[at] = cell_text(cell, shared, dated)
                        row.clear()
                        slice_.append((path, index, values))
                        index += 1
                        if len(slice_) == 5000:
                            yield pd.DataFrame(slice_, columns=["path", "row", "cells"])
                            slice_ = []
                if slice_:
                    yield pd.DataFrame(slice_, columns=["path", "row", "cells"])


def load_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of one workbook or a folder of equally headed workbooks, read in parallel."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    rows = books.mapInPandas(_sheet_rows, "path string, row int, cells array<string>")
    headers = rows.where("row = 0").select("cells").distinct().limit(2).collect()
    if not headers:
        raise AnalysisError(f"path: no row of data in {path}")
    if len(headers) > 1:
        raise AnalysisError("The workbooks have different header rows")
    names = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(headers[0]["cells"])]
    body = rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return infer_types(without_missing_tokens(body))


def load(spark: SparkSession, path: str, format: str | None = None, multiline: bool = True) -> DataFrame:
    """Read a table by its suffix or by an explicit format, normalise it, refuse an empty one."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in FORMATS:
        raise AnalysisError(f"path: {path} is of none of the known formats ({', '.join(FORMATS)})")
    try:
        if kind == "csv":
            df = load_csv(spark, path, multiline)
        elif kind == "xlsx":
            df = load_excel(spark, path)
        else:
            df = spark.read.format(kind).load(path)
        nothing = not df.columns or df.isEmpty()
    except AnalysisError:
        raise
    except Exception as error:
        raise AnalysisError(f"path: {path} does not read as its ending says: {error}") from error
    if nothing:
        raise AnalysisError(f"path: no row of data in {path}")
    return normalize(df)
