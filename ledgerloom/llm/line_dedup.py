"""Line dedup (native): a line stays only in the first document that holds it.

Lines become 128-bit hashes, dealt by hash range with a secondary sort by document and position; the sorted stream's first
document keeps its lines. The result is one run-length bitmap per document, not text.

A hash that a third of all documents hold must not land in one task. So the range key also has a salt of the document, which
cuts a hot hash into `salts` streams. All rows behind a stream's first document are decided there; only rows of that
document (at most `salts` documents per hash are left) keep a common salt for the second stream, which compares the firsts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, content_keys, lower_ascii, order_id


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, salts: int = 32) -> DataFrame:
    """Rows (_id, _h1, _h2, n_lines, kept_runs) for the documents that lose lines.

    kept_runs is the compressed keep bitmap: structs (start, length) of consecutive kept line numbers, from 0, in order.
    _id is the id with null behind all others; _h1, _h2 hash the text, since rows may repeat an id with other texts.

    Null and empty texts have one empty line. Keys are stripped of [\\x20\\x09-\\x0D], A-Z lower-cased, and count from `least`
    code points. Rows with one id are one document: they never take lines from each other, and repeated rows get equal
    bitmaps. Rows without id count as one document behind all others.
    """
    text = F.col(text_col)
    lines = docs.select(
        order_id(F.col(id_col)).alias("_id"), *content_keys(F.coalesce(text, F.lit("")), ("_t1", "_t2")), F.posexplode(_lines(text)).alias("_pos", "_line")
    ).withColumn("_key", lower_ascii(F.btrim("_line", F.lit(BLANKS)))).where(F.length("_key") >= least)
    lines = lines.select("_id", "_t1", "_t2", "_pos", *content_keys(F.col("_key"), ("_h1", "_h2")), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    # The range partitions are in hash order; within them rows are sorted by hash, document and position.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, "_h1", "_salt")
    by = ["_h1", "_salt", "_h2"]
    first = F.first("_id").over(Window.partitionBy(*by).orderBy("_id", "_pos"))
    dealt = dealt.withColumn("_late", F.col("_id") > first)
    # Rows already decided need no comparison: they keep their own salt and stay spread.
    firsts = dealt.withColumn("_salt", F.when(F.col("_late"), F.col("_salt")).otherwise(F.lit(-1)))
    first = F.first("_id").over(Window.partitionBy(*by).orderBy("_id", "_pos"))
    dropped = firsts.withColumn("_late", F.col("_late") | (F.col("_id") > first)).where("_late")
    positions = dropped.groupBy("_id", "_t1", "_t2").agg(F.array_sort(F.collect_set("_pos")).alias("_dropped"))
    return positions


def _kept_runs(dropped: Column, n_lines: Column) -> Column:
    """(start, length) of the runs between the dropped positions."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.struct((F.get(edges, i - 1) + 1).alias("start"), (F.get(edges, i) - F.get(edges, i - 1) - 1).alias("length")),
    )
    return F.filter(runs, lambda r: r["length"] > 0)


def with_line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, salts: int = 32) -> DataFrame:
    """All rows and columns of `docs`, with n_lines, n_dropped, kept_runs (see `line_bitmaps`) and kept_text added.

    The added columns replace columns of those names. See `line_bitmaps` for nulls, ties and repeated rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.drop(*({"n_lines", "n_dropped", "kept_runs", "kept_text"} - {text_col, id_col}))
    keyed = keyed.withColumns({"_id": order_id(F.col(id_col)), "_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})
    joined = keyed.join(line_bitmaps(docs, id_col, text_col, least, salts), ["_id", "_t1", "_t2"], "left")
    lines = _lines(F.col(text_col))
    n_lines = F.size(lines)
    dropped = F.coalesce("_dropped", F.array().cast("array<int>"))
    joined = joined.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.size(dropped).cast("long"), "kept_runs": _kept_runs(dropped, n_lines)})
    kept = F.array_join(F.flatten(F.transform("kept_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return joined.withColumn("kept_text", F.when(F.col("n_dropped") == 0, text).otherwise(kept)).drop("_id", "_t1", "_t2", "_dropped")
