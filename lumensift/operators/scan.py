"""The scan from a folder and rule files to numbered, triaged findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import rulebase
from lumensift.operators.findings import decided, fuse, numbered_by, prefilter, union_engines
from lumensift.operators.match import TextRule, scan_texts
from lumensift.operators.syntax import engine_scan
from lumensift.sources import config as settings
from lumensift.sources import files as sources


def scan(files: DataFrame, rules: list[TextRule], engine: DataFrame | None = None) -> DataFrame:
    """Findings in files (path, text, lang) by rules, with those of the syntax engine in ``engine`` files: of each (file,
    line, rule_id) one, the better engine's. ``ord``: the order in which they come, rules first."""
    number = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.rule_id), F.lit(i))]), F.col("rule_id")) if rules else F.lit(0)
    order = F.struct(F.lit(0).alias("engine"), F.coalesce(number, F.lit(0)).alias("rule"), "file", "regex_no", "match_no")
    found = scan_texts(files, rules).withColumn("ord", order).drop("matched", "regex_no", "match_no")
    if engine is not None:
        place = F.struct(F.lit(1).alias("engine"), F.lit(0).alias("rule"), "file", F.col("line").alias("regex_no"), F.pmod(F.xxhash64("rule_id", "code_snippet"), F.lit(1_000_000_000)).cast("int").alias("match_no"))
        tree = engine_scan(engine).withColumn("metadata", F.create_map(F.lit("cwe"), F.col("cwe"))).drop("cwe")
        found = union_engines(found.withColumn("engine", F.lit(None).cast("string")), tree.withColumn("ord", place))
    else:
        found = found.withColumn("engine", F.lit(None).cast("string"))
    return fuse(found)


def identified(findings: DataFrame, scan_id: str) -> DataFrame:
    """findings with issue_id and ord as numbers in their order."""
    each = numbered_by(findings.withColumnRenamed("first_ord", "_place").drop("ord"), F.col("_place"))
    return each.withColumnRenamed("number", "ord").withColumn("issue_id", T.issue_id(scan_id, F.col("ord"))).drop("_place")


def scan_folder(spark: SparkSession, root: str, rules_folder: str, profile: str = "default", config: dict | None = None, scan_id: str = "scan", syntax: bool = True) -> DataFrame:
    """The whole scan of a folder: rules by profile, both engines, ids, prefilter and decision."""
    rules = rulebase.compiled(rulebase.load_rules(rules_folder, settings.load_profile(rules_folder, profile)), spark)
    found = scan(sources.read_files(spark, root), rules, sources.engine_files(spark, root) if syntax else None)
    triage = settings.prefilter_rules(config) if config is not None else frozenset()
    return decided(prefilter(identified(found, scan_id), triage))
