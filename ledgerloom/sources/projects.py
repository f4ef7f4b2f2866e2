"""The catalogue of projects: a project is a group, a company, a year and a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.schemas import TABLES, conform

KEYS = [f.name for f in TABLES["projects"].fields]


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), "projects")


def project_catalogue(projects: DataFrame) -> DataFrame:
    """The distinct values of every key, one row each; one pass for all four."""
    return projects.select(KEYS).unpivot([], KEYS, "field", "value").distinct()


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below `folder`: path, ok, and the keys of the project that its name states.

    Names are `group_company_year_month.<ending>`; contents are not read. ok is false, and the keys are null, where a
    name does not split into four, such as a company with `_` in its name.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = files.select("path", F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_").alias("parts"))
    ok = F.size("parts") == len(KEYS)
    keys = [F.when(ok, F.col("parts")[i]).alias(key) for i, key in enumerate(KEYS)]
    return parts.select("path", ok.alias("ok"), *keys)


def projects_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The projects that `project_files` finds; files of other names are left to `rejected_project_files`."""
    return project_files(spark, folder).filter("ok").select(KEYS)


def rejected_project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose names state no project."""
    return project_files(spark, folder).filter("NOT ok").select("path")
