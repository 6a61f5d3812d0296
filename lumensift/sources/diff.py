"""Unified diffs as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_lines(patches: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """(key, n, txt, hunk, start): lines of each patch, numbered, with the number of their hunk and its first new line."""
    each = patches.select(key, F.posexplode(F.split(patch, "\n", -1)).alias("n", "txt"))
    within = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("txt").startswith("@@")
    start = F.when(head, F.regexp_extract("txt", r"\+(\d+)", 1).try_cast("int"))
    return each.withColumn("hunk", F.sum(head.cast("int")).over(within)).withColumn("start", F.coalesce(F.last(start, ignorenulls=True).over(within), F.lit(0)))


def changed_lines(patches: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """(key, line): new-file numbers of the added lines. Removed lines don't advance the count, all others do."""
    each = diff_lines(patches, key, patch)
    removed = F.col("txt").startswith("-") & ~F.col("txt").startswith("---")
    added = F.col("txt").startswith("+") & ~F.col("txt").startswith("+++")
    step = F.when(F.col("txt").startswith("@@") | removed, 0).otherwise(1)
    within = Window.partitionBy(key, "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = each.withColumn("line", (F.col("start") + F.sum(step).over(within) - 1).cast("int"))
    return counted.where(added).select(key, "line").distinct()


def hunk_methods(texts: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, file, name, line, end_line): a pseudo method ``line_N`` for each hunk of a diff over several files."""
    each = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "txt"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = F.last(F.when(F.col("txt").startswith("+++ b/"), F.expr("substring(txt, 7)")), ignorenulls=True).over(before)
    each = each.withColumn("file", file).where(F.col("txt").startswith("@@") & F.col("file").isNotNull() & F.col("txt").rlike(r"\+\d+"))
    line = F.regexp_extract("txt", r"\+(\d+)", 1).cast("int")
    return each.select(key, "file", F.concat(F.lit("line_"), line).alias("name"), line.alias("line"), (line + 10).cast("int").alias("end_line"))


def file_stats(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """patches with status, additions and deletions: counts of line starts, the file headers taken off."""
    count = lambda sign: (F.regexp_count(patch, F.lit(f"\n\\{sign}")) - F.regexp_count(patch, F.lit(f"\n\\{sign}\\{sign}\\{sign}"))).cast("int")
    status = F.when(F.col("new_file"), "added").when(F.col("deleted_file"), "deleted").when(F.col("renamed_file"), "renamed").otherwise("modified")
    return patches.withColumns({"status": status, "additions": count("+"), "deletions": count("-")})


def stat_files(texts: DataFrame, key: str = "diff_id", text: str = "stat", as_written: bool = False) -> DataFrame:
    """(key, path, status, additions, deletions) of ``git diff --stat`` output, whose counts aren't read.

    as_written: of lines that start with a blank, as all but the first do, none counts.
    """
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    each = texts.select(key, F.posexplode(F.split(trimmed if as_written else F.col(text), "\n", -1)).alias("n", "txt")).where(F.col("txt").contains("|"))
    if as_written:
        each = each.where(~F.col("txt").startswith(" "))
    return each.select(key, F.trim(F.substring_index("txt", "|", 1)).alias("path"), F.lit("modified").alias("status"), F.lit(0).alias("additions"), F.lit(0).alias("deletions"))
