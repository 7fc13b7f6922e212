"""Deliveries read from files, and the archive written to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.text import guarded

#: The columns of the list of companies, in order.
COMPANY_COLUMNS = ("id", "name", "category", "category_method", "status", "website", "sectors", "locations", "opportunity_count", "last_seen")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row map<string,string>, observed) of files that hold a JSON array of objects, or one object a line.

    Values that aren't text keep their JSON form. `observed` is the file's time of change.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_modification_time").alias("observed"))
    array = F.from_json("v", "array<map<string,string>>")
    lines = F.filter(F.transform(F.split("v", "\n"), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    return files.select(F.explode(F.when(F.ltrim("v").startswith("["), array).otherwise(lines)).alias("row"), "observed")


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row map<string,string>, observed) of CSV files with a header; every value is text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pairs = [x for c in df.columns for x in (F.lit(c.lstrip("﻿")), F.col(f"`{c}`"))]
    return df.select(F.create_map(*pairs).alias("row"), F.col("_metadata.file_modification_time").alias("observed"))


def flat_text(df: DataFrame, by: str) -> DataFrame:
    """Every column as text: lists joined, texts that look like formulas guarded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(guarded(F.array_join(c.cast("array<string>"), by) if kind.startswith("array") else c.cast("string")).alias(name))
    return df.select(*out)


def write_companies_csv(companies: DataFrame, path: str) -> None:
    """The list of companies as CSV with its ten columns, lists joined by a comma."""
    have = set(companies.columns)
    rows = companies.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in COMPANY_COLUMNS])
    flat_text(rows, ", ").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_review_csv(rows: DataFrame, path: str) -> None:
    """A sheet for reviewers as CSV, lists joined by a bar."""
    flat_text(rows, " | ").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_documents_json(documents: DataFrame, path: str) -> None:
    """Whole documents as JSON lines, with the version of their form."""
    documents.select(F.lit("2").alias("schema_version"), "*").write.mode("overwrite").json(path)
