"""A data source for XLSX exports: ``spark.read.format("catalogue_xlsx").load(path)``.

Rows of the products sheet come as arrays of texts (null for empty cells) with the header;
`products` maps them.  One file is one partition, read as a stream of rows.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from xml.etree.ElementTree import iterparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import money, text

SHEET = "Export Products Sheet"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_rows(path):
    """(row number from 0, cells) of the products sheet, else of the first."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in iterparse(z.open("xl/sharedStrings.xml")):
                if _name(e.tag) == "si":
                    shared.append("".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"))
                    e.clear()
        rels = {e.get("Id"): e.get("Target") for _, e in iterparse(z.open("xl/_rels/workbook.xml.rels")) if _name(e.tag) == "Relationship"}
        sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if _name(k) == "id")) for _, e in iterparse(z.open("xl/workbook.xml")) if _name(e.tag) == "sheet"]
        target = rels[dict(sheets).get(SHEET, sheets[0][1])].lstrip("/").removeprefix("xl/")
        at = 0
        for _, row in iterparse(z.open(f"xl/{target}")):
            if _name(row.tag) != "row":
                continue
            cells: list[str | None] = []
            for c in row:
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                value = "".join(t.text or "" for t in c.iter() if _name(t.tag) in ("v", "t"))
                cells[i] = (shared[int(value)] if c.get("t") == "s" and value else value) or None
            yield at, cells
            at += 1
            row.clear()


class _File(InputPartition):
    def __init__(self, path):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.xlsx"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition):
        header = None
        for at, cells in read_rows(partition.path):
            if header is None:
                header = [(h or "").strip() for h in cells]
                missing = [n for n in ("Код_товару", "Ціна") if n not in header]
                if missing:
                    raise ValueError(f"{partition.path} isn't a catalogue export: no columns {missing}")
            elif any(cells):
                yield partition.path, at, header, cells


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "catalogue_xlsx"

    def schema(self):
        return "file string, row int, header array<string>, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("catalogue_xlsx").load(path)


def value(header: str) -> Column:
    """The first non-empty cell among a header's columns."""
    pairs = F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c"))
    return F.get(F.filter(pairs, lambda p: (p["h"] == header) & (F.coalesce(p["c"], F.lit("")) != "")), F.lit(0))["c"]


def characteristic(name: str) -> Column:
    """The value of the first characteristic with that name."""
    pick = lambda h: F.transform(F.filter(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c")), lambda p: p["h"] == h), lambda p: p["c"])
    pairs = F.arrays_zip(pick("Назва_Характеристики").alias("n"), pick("Значення_Характеристики").alias("v"))
    return F.get(F.filter(pairs, lambda p: (F.trim(p["n"]) == name) & (F.coalesce(p["v"], F.lit("")) != "")), F.lit(0))["v"]


def products(rows: DataFrame, codes=("Код_товару", "Номер_пристрою_(MPN)"), numbers=("Код запчастини", "Кросс-номери"), phrases=("Пошукові_запити",)) -> DataFrame:
    """Products of export rows; rows without a whole-number id, a name or a link are left out."""
    listed = [F.split(F.coalesce(characteristic(n), F.lit("")), ",") for n in numbers]
    own = F.transform(F.concat(F.array(*[value(c) for c in codes]), *listed), text.normalize_oem)
    own = F.array_distinct(F.filter(own, lambda x: x.isNotNull()))
    asked = F.concat(*[text.number_list(value(p)) for p in phrases])
    out = rows.select(
        F.trim(value("Унікальний_ідентифікатор")).try_cast("bigint").alias("id"), F.trim(F.coalesce(value("Назва_позиції_укр"), value("Назва_позиції"))).alias("name"), F.trim(value("Код_товару")).alias("sku"),
        value("Ціна").alias("price"), F.coalesce(value("Валюта"), F.lit("UAH")).alias("currency"), (F.trim(F.coalesce(value("Наявність"), F.lit(""))) != "-").alias("is_available"),
        text.present(value("Одиниця_виміру")).alias("measure_unit"), text.present(value("Виробник")).alias("brand"), text.present(value("Посилання_зображення")).alias("image"),
        F.trim(value("Продукт_на_сайті")).alias("url"), text.order_numbers(F.concat(own, asked)).alias("oem_numbers"), money.parse_price(value("Ціна")).alias("parsed_price"),
    )
    return out.where("id IS NOT NULL AND coalesce(name, '') <> '' AND coalesce(url, '') <> ''")
