"""Reading exports (CSV or Parquet) through their contracts."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window, WindowSpec, functions as F
from pyspark.sql.types import DataType

from ledgerloom.fixed_values import EMPTY_SOURCE
from ledgerloom.schemas import TABLES, conform
from ledgerloom.sources.contracts import Contract


def unquote(path: str) -> str:
    """Strip one pair of outer quotes, as pasted from a file manager."""
    if len(path) > 1 and path[0] in "'\"" and path[-1] == path[0]:
        return path[1:-1]
    return path


def read_raw(spark: SparkSession, path: str, header_row: int = 0, required: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """All columns of an export, header names trimmed. CSV columns are text; nothing is inferred.

    Every CSV file is read by its own header and files are put together by name, so their column
    orders may differ. A header cell without a name is called by its place (`_c3`). A file that
    lacks one of the `required` columns is named in the error. Quoted cells may hold line breaks, which
    come back as line feeds. `positions` adds `_file`, `_block` and `_line`, by which rows stand in their files.
    """
    path = unquote(path)
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz", ".txt")):
        parts = read_csv_files(spark, path, header_row, positions)
    else:
        whole = spark.read.parquet(path)
        place = [F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"), F.col("_metadata.row_index").alias("_line")]
        parts = [(path, whole.select("*", *place) if positions else whole)]
    result = None
    for file, df in parts:
        df = df.toDF(*[c.strip() for c in df.columns])
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{file}: missing required columns {missing}")
        result = df if result is None else result.unionByName(df, allowMissingColumns=True)
    return result


def _states(lines: DataFrame) -> DataFrame:
    """What a line does to an open quote: `from_out` and `from_in`, whether a quoted cell is open behind the line if none
    was open before it, and if one was. Doubled quotes don't count; a quote opens a cell only at the cell's beginning."""
    marks = F.replace("value", F.lit('""'), F.lit(""))
    rest = F.expr("substring(_marks, instr(_marks, '\"') + 1)")
    open_after = F.regexp_like(F.regexp_replace("_marks", '(^|,)"[^"]*"', "$1"), F.lit('(^|,)"'))
    open_inside = F.regexp_like(F.regexp_replace(rest, ',"[^"]*"', ","), F.lit(',"'))
    none = ~F.col("value").contains('"')
    return lines.withColumn("_marks", marks).withColumns({
        "from_out": F.when(none, F.lit(0)).otherwise(open_after.cast("int")),
        "from_in": F.when(none | ~F.col("_marks").contains('"'), F.lit(1)).otherwise(open_inside.cast("int")),
    }).drop("_marks")


def _running(lines: DataFrame, window: WindowSpec, out: str, through: str, settled: str) -> DataFrame:
    """`through`: how often the rows up to here swap the state, mod 2. `settled`: what the last row that fixes the state leaves,
    less the swaps up to it; NULL if none has. Both together give the state for any beginning."""
    rows = lines.withColumn(through, F.sum(F.when((F.col(f"{out}_out") == 1) & (F.col(f"{out}_in") == 0), 1).otherwise(0)).over(window) % 2)
    fixed = F.when(F.col(f"{out}_out") == F.col(f"{out}_in"), (F.col(f"{out}_out") + F.col(through)) % 2)
    return rows.withColumn(settled, F.last(fixed, ignorenulls=True).over(window))


def joined_records(lines: DataFrame) -> DataFrame:
    """Lines (file, block, position, value) as CSV records: a quoted cell may go on over lines and blocks.

    Each block is read by itself. What it does to a quote that is open at its beginning is one row, and a running state over
    a file's blocks tells each block how it begins. Lines of one record are put together by where the record began, with a
    line feed between them; all others pass on. A quote that is never closed takes the rest of its file with it.
    """
    in_block = Window.partitionBy("file", "block").orderBy("position")
    rows = _running(_states(lines), in_block, "from", "swaps", "settled")
    ends = rows.groupBy("file", "block").agg(F.max_by(F.struct("swaps", "settled"), "position").alias("e"))
    ends = ends.select(
        "file", "block", F.coalesce((F.col("e.settled") + F.col("e.swaps")) % 2, F.col("e.swaps")).alias("block_out"),
        F.coalesce((F.col("e.settled") + F.col("e.swaps")) % 2, 1 - F.col("e.swaps")).alias("block_in"),
    )
    blocks = Window.partitionBy("file").orderBy("block")
    ends = _running(ends, blocks, "block", "block_swaps", "block_settled")
    state = (F.coalesce("block_settled", F.lit(0)) + F.col("block_swaps")) % 2
    begins = ends.select("file", "block", F.lag(state, 1, 0).over(blocks).alias("begins"))

    after = (F.coalesce("settled", F.col("begins")) + F.col("swaps")) % 2
    rows = rows.join(begins, ["file", "block"]).withColumn("after", after)
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(in_block), F.col("begins")))
    whole = rows.where("before = 0 AND after = 0")
    parts = rows.where("before = 1 OR after = 1")
    starts = F.when(F.col("before") == 0, F.struct("block", "position"))
    parts = parts.withColumn("start", F.last(starts, ignorenulls=True).over(in_block))
    carried = parts.groupBy("file", "block").agg(F.max("start").alias("last"))
    carried = carried.select("file", "block", F.max("last").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    parts = parts.join(carried, ["file", "block"]).withColumn("start", F.coalesce("start", "carried"))
    lists = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "position", "value"))).alias("lines"))
    records = lists.select("file", "start.block", "start.position", F.array_join("lines.value", "\n").alias("value"))
    return whole.where(F.trim("value") != "").select("file", "block", "position", "value").unionByName(records)


def read_csv_files(spark: SparkSession, path: str, header_row: int, positions: bool = False) -> list[tuple[str, DataFrame]]:
    """One frame for each distinct header of the CSV files below `path`, with one of its files.

    The header is on line `header_row`, with other text above it, and is one line. Line numbers are needed only in the first
    block of each file, so only those blocks are numbered; the remaining blocks pass straight through. One look at the lines
    finds the headers and whether any line leaves a quoted cell open; only then are lines put together to records, by blocks
    (`joined_records`). A gzip file is one block. What reaches the driver is one row per distinct header. With `positions`
    each record has its `_file` and `_block`, and its number there from 0 as `_line`.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )
    first = lines.filter(F.col("block") == 0)
    if header_row:
        numbered = first.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("position")) - 1)
        headers = numbered.filter(F.col("line") == header_row).select("file", "value")
        body = numbered.filter(F.col("line") > header_row).drop("line")
    else:
        headers = first.groupBy("file").agg(F.min_by("value", "position").alias("value"))
        starts = first.groupBy("file").agg(F.min("position").alias("start"))
        body = first.join(starts, "file").filter(F.col("position") > F.col("start")).drop("start")
    found = headers.groupBy("value").agg(F.min("file").alias("file")).sort("file").collect()
    if not found and header_row:
        raise ValueError(f"{path}: no header on line {header_row}")
    body = body.select(*lines.columns).unionByName(lines.filter(F.col("block") > 0))
    across = not _states(body).where("from_out = 1").isEmpty()
    if not header_row and len(found) < 2 and not across and not positions:
        return [(path, spark.read.csv(path, header=True, escape='"'))]
    body = joined_records(body) if across else body.filter(F.trim("value") != "")
    if len(found) > 1:
        body = body.join(headers.select("file", F.col("value").alias("header")), "file")
    place = {"_file": "file", "_block": "block", "_line": "line"} if positions else {}
    if positions:
        body = body.withColumn("line", F.row_number().over(Window.partitionBy("file", "block").orderBy("position")).cast("long") - 1)
    parts = []
    for row in found:
        names = _split_header(spark, row["value"])
        own = body.filter(F.col("header") == row["value"]) if len(found) > 1 else body
        parsed = own.select("*", F.from_csv("value", _text_fields(len(names)), {"escape": '"'}).alias("r"))
        columns = [F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)]
        parts.append((row["file"], parsed.select(columns + [F.col(c).alias(name) for name, c in place.items()])))
    return parts


def _text_fields(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _split_header(spark: SparkSession, line: str) -> list[str]:
    """The names on a header line; cells without one keep their place. Quoted commas leave no cells behind."""
    width = line.count(",") + 1
    quoted = sum(part.count(",") for part in line.split('"')[1::2])
    row = spark.range(1).select(F.from_csv(F.lit(line), _text_fields(width)).alias("r")).select("r.*").first()
    return [name if name is not None and name.strip() else f"_c{i}" for i, name in enumerate(row[: width - quoted])]


class BadValues:
    """Values that do not fit their column's type, counted by source and column while the tables are written.

    A frame that is watched turns such a value into NULL. The counts are those of the first job over the frame, so save the
    tables before anything else is done with them; `flows.save_tables` keeps a load with bad values out of the tables.
    """

    def __init__(self):
        self._watched: list[tuple[str, list[str], Observation]] = []

    def typed(self, df: DataFrame, source: str, types: dict[str, DataType]) -> DataFrame:
        """`df` with those of its columns that `types` names cast, and counted."""
        own = {c: t for c, t in types.items() if c in df.columns and t != df.schema[c].dataType}
        if not own:
            return df
        seen = Observation(f"bad values of {source} {uuid.uuid4().hex}")
        counts = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"c{i}") for i, (c, t) in enumerate(own.items())]
        self._watched.append((source, list(own), seen))
        return df.observe(seen, *counts).withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in own.items()})

    def rows(self) -> list[tuple[str, str, int]]:
        """(source, column, count) where there are any. Waits for the tables of all watched sources."""
        found = [(source, c, seen.get[f"c{i}"]) for source, columns, seen in self._watched for i, c in enumerate(columns)]
        return [row for row in found if row[2]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "source string, column string, bad_values long")


def contract_scan(spark: SparkSession, path: str, contract: Contract, bad: BadValues | None = None, source: str = "") -> DataFrame:
    """Required columns under canonical names and types; a missing one is named in the error.

    A value that does not fit its type is an error when it is read, or counted by `bad`. A contract with `positions` adds
    `id`, the rows' number in the source.
    """
    if path == EMPTY_SOURCE:
        return empty(spark, contract.table or "fx_revaluation")
    df = read_raw(spark, path, contract.header_row, tuple(contract.columns), contract.positions)
    if not contract.columns:
        return df
    place = []
    if contract.positions:
        df, place = numbered(df), ["id"]
    renamed = df.select([F.col(f"`{source}`").alias(name) for source, name in contract.columns.items()] + place)
    if bad is not None and contract.table:
        renamed = bad.typed(renamed, source, {f.name: f.dataType for f in TABLES[contract.table].fields})
    return conform(renamed, contract.table) if contract.table else renamed


def numbered(df: DataFrame) -> DataFrame:
    """Rows of `read_raw` with positions, numbered 0, 1, 2, ... in the order of files and of rows in them, as `id`.

    A row has its number within its block from the reader; what earlier blocks hold is one row a block. Nothing is sorted
    as a whole, and no job runs before the rows are used.
    """
    counts = df.groupBy("_file", "_block").agg(F.count("*").alias("n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return df.join(offsets, ["_file", "_block"]).withColumn("id", F.col("_before") + F.col("_line")).drop("_file", "_block", "_line", "_before")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def load_sources(
    spark: SparkSession, paths: dict[str, str], contracts: dict[str, Contract], bad: BadValues | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every source by task name, plus a load status. A source that fails is left out and reported.

    Whether a source's values fit their types is known only when they are read: `bad` counts those that don't.
    """
    frames, status = {}, []
    for name, contract in contracts.items():
        try:
            if name not in paths:
                raise ValueError(f"no path for {name}")
            frames[name] = contract_scan(spark, paths[name], contract, bad, name)
            status.append((name, True, None))
        except (PySparkException, ValueError) as error:
            if contract.optional and contract.table:
                frames[name] = empty(spark, contract.table)
            status.append((name, False, str(error).split("\n")[0]))
    return frames, spark.createDataFrame(status, "source string, ok boolean, error string")


def adjustment_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All adjustment sheets of one template: a dataset with a `kind=` directory per sheet."""
    path = unquote(path)
    reader = spark.read.option("basePath", path)
    return reader.parquet(path)
