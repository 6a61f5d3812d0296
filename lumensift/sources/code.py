"""Method definitions and calls of source texts, by the patterns of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions.text import RESERVED
from lumensift.sources.files import changed_files, lines, located

# What counts as a definition.
JAVA = r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
PYTHON = r"def\s+(\w+)\s*\("
SCRIPT = [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>"]
PATTERNS = {"java": [JAVA], "python": [PYTHON], "javascript": SCRIPT, "typescript": SCRIPT}
# What a changed file's definitions are, and how many lines each is taken to have.
CHANGED = {
    "java": ([JAVA], 20),
    "python": ([r"(?:def\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[\w\[\],\s]+)?\s*:)"], 30),
    "javascript": ([r"(?:function\s+(\w+)\s*\([^)]*\)\s*\{)", SCRIPT[1], r"(?:class\s+(\w+))"], 25),
}
CHANGED["typescript"] = CHANGED["javascript"]
CALL = r"(\w+)\s*\("
#: Lines of a body, from its definition on, that are searched for calls.
BODY = 50


def _definitions(files: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(path, lang, name, line): files are read once, whatever the number of patterns."""
    tests = [(lang, regex) for lang, own in patterns.items() for regex in own]
    tried = F.array(*[F.when((F.col("lang") == lang) & F.col("text").rlike(regex), F.lit(regex)) for lang, regex in tests])
    each = files.select("path", "lang", "text", F.explode(F.filter(tried, lambda r: r.isNotNull())).alias("_regex"))
    found = located(each, F.col("text"), F.col("_regex"))
    return found.select("path", "lang", F.expr("regexp_extract(matched, _regex, 1)").alias("name"), "line")


def method_defs(files: DataFrame, reserved: bool = True) -> DataFrame:
    """(path, name, line) of files (path, text, lang); reserved: leave out reserved words, as call graphs do."""
    out = _definitions(files, PATTERNS)
    if reserved:
        out = out.where(~((F.col("lang") == "java") & F.col("name").isin(RESERVED)))
    return out.select("path", "name", "line")


def changed_defs(files: DataFrame) -> DataFrame:
    """(path, name, line, end_line) of definitions as the diff source sees them: classes of scripts too, ends by a guess."""
    out = _definitions(files, {lang: patterns for lang, (patterns, _) in CHANGED.items()})
    length = F.element_at(F.create_map(*[F.lit(x) for lang, (_, n) in CHANGED.items() for x in (lang, n)]), F.col("lang"))
    return out.select("path", "name", "line", (F.col("line") + length).cast("int").alias("end_line"))


def full_scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a scan of a whole folder reports: every file, unchanged, and all definitions in them."""
    return changed_files(files), changed_defs(files).withColumnRenamed("path", "file")


def call_edges(files: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, caller, callee), a row per call: a name of the same file, before a parenthesis, within the caller's body."""
    called = lines(files.select("path", "text")).select("path", "line", F.explode(F.regexp_extract_all("txt", F.lit(CALL), F.lit(1))).alias("callee"))
    names = methods.select("path", F.col("name").alias("callee")).distinct()
    called = called.join(names, ["path", "callee"], "left_semi")
    own = methods.select(F.col("path").alias("p"), F.col("name").alias("caller"), F.col("line").alias("start"))
    near = (called["path"] == own["p"]) & (called["line"] >= own["start"]) & (called["line"] < own["start"] + BODY) & (called["callee"] != own["caller"])
    return called.join(own, near).select("path", "caller", "callee")


def has_call(text: Column, name: str) -> Column:
    return text.rlike(rf"\b{name}\s*\(")
