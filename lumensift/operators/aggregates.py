"""Summaries, accuracy, confusion metrics and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.functions import text as T


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, 0 without a whole."""
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def severity_summary(findings: DataFrame) -> DataFrame:
    level = T.reported_severity(F.col("severity"), F.col("category"))
    counts = [F.count_if(F.col("_level") == name).alias(name) for name in ("critical", "high", "medium", "low")]
    return findings.withColumn("_level", level).agg(F.count(F.lit(1)).alias("total"), *counts)


def counted(findings: DataFrame, by: str, missing: str = "unknown") -> DataFrame:
    return findings.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias(by)).agg(F.count(F.lit(1)).alias("n"))


def top(findings: DataFrame, by: str, order: str, k: int = 20) -> DataFrame:
    """The k most frequent values with their rank; of equal counts, the one that came first."""
    counts = findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))
    best = counts.orderBy(F.desc("n"), "first_ord").limit(k)  # k rows: the window below is over these alone
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_ord"))).select("rank", by, "n")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    kinds = ["confirmed", "false_positive", "uncertain"]
    return feedback.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def judged(decisions: DataFrame, feedback: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """decisions with feedback, by the last one of each issue, and whether the decision was right."""
    last = feedback.groupBy(*keys).agg(F.max_by("verdict", order).alias("verdict"))
    right = ((F.col("ai_action") == "keep") & (F.col("verdict") == "confirmed")) | ((F.col("ai_action") == "drop") & (F.col("verdict") == "false_positive"))
    return decisions.join(last, keys).withColumn("correct", F.coalesce(right, F.lit(False)))


def accuracy(decided: DataFrame, *by: str) -> DataFrame:
    n, right = F.count(F.lit(1)), F.count_if("correct")
    rows = decided.groupBy(*by) if by else decided
    return rows.agg(n.alias("total_with_feedback"), right.alias("correct"), (n - right).alias("incorrect"), ratio(right, n).alias("accuracy"))


def confusion(n_known: Column, n_hit: Column, n_found: Column, n_right: Column) -> list[Column]:
    recall, precision = ratio(n_hit, n_known), ratio(n_right, n_found)
    f1 = F.round(F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0)), 6)
    return [recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), ratio(n_found - n_right, n_found).alias("false_positive_rate"), ratio(n_known - n_hit, n_known).alias("false_negative_rate")]


def cache_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, content) with status: cached, outdated or not_compiled, by the SHA-256 of the content."""
    joined = files.withColumn("hash", F.sha2("content", 256)).join(manifest.select("path", F.col("hash").alias("cached_hash")), "path", "left")
    status = F.when(F.col("cached_hash").isNull(), "not_compiled").when(F.col("cached_hash") == F.col("hash"), "cached").otherwise("outdated")
    return joined.select("path", status.alias("status"), F.left("hash", F.lit(8)).alias("hash"), F.left("cached_hash", F.lit(8)).alias("cached_hash"))


def test_verdicts(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Rule test cases with what hit them: a violation passes if all expected rules did, a correct sample if none did."""
    actual = hits.groupBy("case_id").agg(F.array_sort(F.collect_set("rule_id")).alias("actual"))
    joined = cases.join(actual, "case_id", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    ok = F.when(F.col("is_violation"), F.size(F.array_except("expected", "actual")) == 0).otherwise(F.size("actual") == 0)
    return joined.withColumn("passed", ok)


def _without(low: Column, high: Column) -> Column:
    """The entries of a map whose keys another one lacks."""
    return F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k))


def overlaid(rows: DataFrame, key: str, name: str, layers: list[str]) -> DataFrame:
    """(key, name, value) of rows with a column for each layer of settings: the last layer that says anything wins."""
    layer = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct(name, F.col(c).alias("value"))), lambda e: e["value"].isNotNull()))
    maps = rows.groupBy(key).agg(*[layer(c).alias(c) for c in layers])
    merged = F.col(layers[0])
    for c in layers[1:]:
        merged = F.map_concat(_without(merged, F.col(c)), F.col(c))
    return maps.select(key, F.explode(merged).alias(name, "value"))
