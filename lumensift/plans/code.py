"""Queries on inline source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.operators import joins as J
from lumensift.plans.data import CODE, values
from lumensift.plans.registry import query
from lumensift.sources import code as C
from lumensift.sources.files import lines

FILES_SQL = values(CODE, "path, lang, text")


def _files(spark):
    return spark.createDataFrame(CODE, "path string, lang string, text string")


def _defs_sql() -> str:
    parts = []
    for lang in ("java", "python", "javascript"):
        for regex in C.PATTERNS[lang]:
            rx = regex.replace("'", "''")
            parts.append(f"""SELECT path, lang, gaps, own, unnest(own) AS matched, generate_subscripts(own, 1)::INT AS k, '{rx}' AS rx FROM (SELECT path, lang, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS own FROM {FILES_SQL} WHERE lang = '{lang}')""")
    each = " UNION ALL ".join(parts)
    nl = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: len(y) - len(replace(y, chr(10), '')))), 0)"
    reserved = ", ".join(repr(w) for w in C.RESERVED)
    return f"""e AS ({each}), defs AS (SELECT path, regexp_extract(matched, rx, 1) AS name, (1 + {nl('gaps[1:k]')} + {nl('own[1:k - 1]')})::INT AS line, lang FROM e),
      methods AS (SELECT path, name, line FROM defs WHERE NOT (lang = 'java' AND name IN ({reserved})))"""


DEFS_CTE = _defs_sql()
LINES_SQL = f"(SELECT path, unnest(ls) AS txt, generate_subscripts(ls, 1)::INT AS line FROM (SELECT path, string_split(text, chr(10)) AS ls FROM {FILES_SQL}))"


@query(f"WITH {DEFS_CTE} SELECT path, name, line FROM methods")
def method_defs(spark, sf_dir):
    return C.method_defs(_files(spark))


@query(rf"WITH {DEFS_CTE}, c AS (SELECT path, line, unnest(regexp_extract_all(txt, '(\w+)\s*\(', 1)) AS callee FROM {LINES_SQL}) SELECT m.path, m.name AS caller, c.callee FROM methods m JOIN c ON c.path = m.path AND c.line >= m.line AND c.line < m.line + 50 AND c.callee <> m.name WHERE (c.path, c.callee) IN (SELECT (path, name) FROM methods)")
def call_edges(spark, sf_dir):
    files = _files(spark)
    return C.call_edges(files, C.method_defs(files))


@query(f"WITH {DEFS_CTE}, c AS (SELECT path, line FROM {LINES_SQL} WHERE contains(txt, 'return')) SELECT DISTINCT m.path, m.name FROM methods m JOIN c ON c.path = m.path AND c.line BETWEEN m.line AND m.line + 20")
def changed_methods(spark, sf_dir):
    files = _files(spark)
    methods = C.method_defs(files).withColumn("end_line", F.col("line") + 20)
    changed = lines(files.select("path", "text")).where(F.col("txt").contains("return")).select("path", F.col("line").alias("changed_line"))
    return J.overlapping(methods, changed, "path").select("path", "name").distinct()
