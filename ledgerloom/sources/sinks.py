"""Writing tables per project and exporting workpapers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources.projects import KEYS


#: The file that names the version to read, and the folders of versions: a partition column that readers drop.
MANIFEST, VERSION = "_current", "version"

# Characters that a partition directory name writes as %XX.
_ESCAPED = set("\"#%'*/:=?\\{}[]^\x7f") | {chr(c) for c in range(1, 32)}


def project_path(path: str, project: dict[str, str] | None) -> str:
    """The partition directory of one project, or the table itself."""
    def escape(value: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)

    if not project:
        return path
    return "/".join([path, *[f"{key}={escape(str(project[key]))}" for key in KEYS]])


def stage(df: DataFrame, path: str, project: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> tuple[str, str]:
    """Write a new version of a table, or of one project of it, which nobody reads yet; gives its folder and its name.

    `by` adds partition columns; open items split by `period_tag` and `source_tag` let the
    opening and the closing side each read their own files only.
    """
    target, version = project_path(path, project), f"{VERSION}={uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{target}/{version}")
    return target, version


def switch(spark: SparkSession, target: str, version: str) -> None:
    """Make a staged version the one that is read, by a rename, and remove the others."""
    files, folder = _files(spark, target)
    place = spark._jvm.org.apache.hadoop.fs.Path
    note = place(folder, f"_next-{uuid.uuid4().hex}")
    out = files.create(note)
    out.writeBytes(version)
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(note, place(folder, MANIFEST), overwrite)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{VERSION}=") and name != version:
            files.delete(status.getPath(), True)


def discard(spark: SparkSession, target: str, version: str) -> None:
    """Remove a version that was staged and not switched to."""
    files, folder = _files(spark, target)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, version), True)


def write_table(df: DataFrame, path: str, project: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> None:
    """Replace a table. With a project, replace that project's part and leave the others.

    The new rows are written beside the old ones, which are read until the last file is there; a write that fails leaves
    them as they were. An empty load empties the table or the project.
    """
    switch(df.sparkSession, *stage(df, path, project, by))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, path: str, project: dict[str, str] | None) -> list[str]:
    """The folders to read: of one project or plain table, or of every project below `path`."""
    files, top = _files(spark, project_path(path, project))
    pattern = [MANIFEST] if project else [MANIFEST, "/".join([*["*"] * len(KEYS), MANIFEST])]
    found = []
    for name in pattern:
        for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, name)) or []:
            stream = files.open(status.getPath())
            version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append(f"{status.getPath().getParent().toString()}/{version}")
    return found


ROW_ORDER = ["section", "seq", "account_code", "party_code", "currency", "account_name", "party_name"]


def read_table(
    spark: SparkSession, path: str, project: dict[str, str] | None = None, schema: StructType | None = None
) -> DataFrame:
    """A table, or one project of it. Without a project the four project keys are columns, and
    filters on them prune partitions."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    versions = _versions(spark, path, project)
    if not versions:  # files that another program wrote
        return reader.parquet(project_path(path, project))
    if project or f"/{KEYS[0]}=" not in versions[0].removeprefix(path):
        return reader.option("basePath", versions[0]).parquet(versions[0])
    return reader.option("basePath", path).parquet(*versions).drop(VERSION)


def in_order(df: DataFrame) -> DataFrame:
    """Rows in the published order: by section and number, then account, party, currency and names, so no section is
    one sort key. A frame without any of these columns stays as it is."""
    order = [c for c in ROW_ORDER if c in df.columns]
    return df.sort(*order) if order else df


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Display labels in place of canonical names, in label order; rows in the published order."""
    return in_order(df).select([F.col(c).alias(label) for c, label in labels.items() if c in df.columns])


def export(df: DataFrame, path: str, labels: dict[str, str] | None = None, fmt: str = "csv") -> None:
    """Write a workpaper for reading elsewhere, as CSV with a header or as Parquet, in the published order."""
    out = with_labels(df, labels) if labels else in_order(df)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.parquet(path)
