"""Texts and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.functions.needles import may_match


def read_files(spark: SparkSession, root: str, extensions: list[str] = T.SOURCE_EXTENSIONS, skipped: list[str] = T.SOURCE_SKIPPED) -> DataFrame:
    """(path, text, ext, lang) of a folder's source files; the walk's filters are on the path, before a file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    files = files.withColumn("path", relative).where(T.kept_file(F.col("path"), extensions, skipped))
    ext = T.extension(F.col("path"))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), ext.alias("ext"), T.language_of(ext).alias("lang"))


def graph_files(spark: SparkSession, root: str, language: str = "java") -> DataFrame:
    """The files that the call graph of a language reads."""
    return read_files(spark, root, T.GRAPH_EXTENSIONS.get(language.lower(), T.GRAPH_OTHERWISE), T.GRAPH_SKIPPED)


def engine_files(spark: SparkSession, root: str) -> DataFrame:
    """The files that the syntax engine reads, with its own languages."""
    files = read_files(spark, root, T.ENGINE_EXTENSIONS, T.ENGINE_SKIPPED)
    return files.withColumn("lang", T.language_of(F.col("ext"), T.ENGINE_LANGUAGES))


def changed_files(files: DataFrame) -> DataFrame:
    """What a full scan reports: every file, unchanged."""
    return files.select("path", F.lit("unchanged").alias("status"), F.lit(0).alias("additions"), F.lit(0).alias("deletions"))


def lines(texts: DataFrame, text: str = "text", keep_all: bool = False) -> DataFrame:
    """A row per line: the other columns, line (from 1), txt, n_lines; keep_all: all lines as well, as an array ``ls``."""
    others = [c for c in texts.columns if c != text]
    split = texts.select(*others, F.split(text, "\n", -1).alias("ls"))
    out = split.select(*others, "ls", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("pos", "txt")).withColumn("line", (F.col("pos") + 1).cast("int"))
    return out.drop("pos") if keep_all else out.drop("pos", "ls")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def multiline_matches(texts: DataFrame, key: str, regex: str, text: str = "text") -> DataFrame:
    """(key, k, line, matched): all matches of a regex over whole texts, k from 1, with the line on which each starts.

    What lies between matches and the matches themselves come from built-ins; line numbers are running sums of their
    line ends within one text.
    """
    cheap = may_match(F.col(text), F.lower(text), regex)
    own = texts.select(key, text)
    out = located(own if cheap is None else own.where(cheap), F.col(text), F.lit(regex))
    return out.select(key, "k", "line", "matched")


def located(texts: DataFrame, text: Column, regex: Column) -> DataFrame:
    """texts once for each match of the expression in the text, with k (from 1), line and matched."""
    columns = texts.columns
    whole = texts.select("*", F.split(text, regex, -1).alias("_between"), F.regexp_extract_all(text, regex, F.lit(0)).alias("_found"))
    whole = whole.where(F.size("_found") > 0)
    pieces = whole.select(*columns, "_found", F.transform("_between", lambda p: newlines(p)).alias("_gaps"), F.transform("_found", lambda m: newlines(m)).alias("_own"))
    each = pieces.select(*columns, "_gaps", "_own", F.posexplode("_found").alias("_i", "matched"))
    before = F.aggregate(F.slice("_gaps", 1, F.col("_i") + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("_own", 1, F.col("_i")), F.lit(0), lambda a, x: a + x)
    return each.select(*columns, (F.col("_i") + 1).cast("int").alias("k"), (before + 1).cast("int").alias("line"), "matched")
