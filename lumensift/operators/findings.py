"""Fusing, numbering, triage and review of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.operators.tables import settled

# Rank of each engine; a finding without one counts as semgrep's, others rank 99.
ENGINE_PRIORITY = {"ast": 0, "semgrep": 1, "regex": 2, "builtin": 2}


def union_engines(*found: DataFrame) -> DataFrame:
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def engine_rank(engine: Column) -> Column:
    pairs = [F.lit(x) for p in ENGINE_PRIORITY.items() for x in p]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(engine, F.lit("semgrep"))), F.lit(99))


def fuse(findings: DataFrame, order: str = "ord") -> DataFrame:
    """One finding per (file, line, rule_id): the best engine's, the first of equals; first_ord: where its key came first."""
    rank = engine_rank(F.col("engine"))
    best = F.min_by(F.struct(*findings.columns), F.struct(rank, order))
    return findings.groupBy("file", "line", "rule_id").agg(best.alias("f"), F.min(order).alias("first_ord")).select("f.*", "first_ord")


def numbered(df: DataFrame, key: str, *then: str, start: int = 0, span: int = 4096) -> DataFrame:
    """df with ``number``: the row's place by key (a whole number), then by the other columns.

    In levels: rows are numbered inside ranges of ``span`` keys, and ranges get the count of rows before them, so that no
    task holds all rows.
    """
    df = df.withColumn("_range", F.floor(F.col(key) / span))
    counts = df.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.floor(F.col("_range") / span))
    # ranges of ranges: what one task holds of them is a row for each span * span keys
    supers = counts.groupBy("_super").agg(F.sum("_n").alias("_m"))
    supers = supers.select("_super", F.coalesce(F.sum("_m").over(Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    before = Window.partitionBy("_super").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(supers, "_super")
    counts = counts.select("_range", (F.col("_before") + F.col("_first")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key, *then)
    out = df.withColumn("_place", F.row_number().over(inside)).join(counts, "_range")
    return out.withColumn("number", (F.col("_before") + F.col("_place") - 1 + start).cast("long")).drop("_range", "_place", "_before")


def numbered_by(df: DataFrame, *order: Column, start: int = 0) -> DataFrame:
    """df with ``number`` by any order: a range-partitioned table, the counts of its partitions, and places inside them."""
    names = [f"_o{i}" for i in range(len(order))]
    # stored before it is dealt by range: sampling the ranges would compute it a second time
    keyed = settled(df.withColumns(dict(zip(names, order, strict=True)))).repartitionByRange(*names)
    keyed = settled(keyed.withColumn("_part", F.spark_partition_id()))
    counts = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    out = keyed.withColumn("_place", place).join(counts, "_part")
    return out.withColumn("number", (F.col("_before") + F.col("_place") - 1 + start).cast("long")).select(*df.columns, "number")


def prefilter(findings: DataFrame, enabled: frozenset[str] = frozenset({"sqli-mybatis-dollar", "crypto-hardcoded-key-java", "naming-*", "short-code-snippet"})) -> DataFrame:
    """findings with is_false_positive, ai_confidence, needs_review, prefilter_reason: the first rule that fits decides."""
    rule, file, snippet = F.col("rule_id"), F.col("file"), F.coalesce("code_snippet", F.lit(""))
    context = rule.startswith("null-java-") | rule.startswith("path-traversal-") | rule.startswith("xss-") | rule.startswith("sqli-")
    rules = [
        ("sqli-mybatis-dollar", (rule == "sqli-mybatis-dollar") & file.endswith(".xml") & snippet.contains("${") & snippet.contains("}"), "sqli-mybatis-dollar in pom.xml", 0.99),
        ("crypto-hardcoded-key-java", (rule == "crypto-hardcoded-key-java") & F.lower(file).contains("constants"), "crypto-hardcoded-key in Constants class", 0.95),
        ("naming-*", rule.startswith("naming-"), "naming-* style rule", 0.90),
        ("short-code-snippet", context & (F.size(F.split(snippet, "\n")) < 5), "code_snippet too short", None),
    ]
    reason, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, fits, why, sure in reversed(rules):
        if name in enabled:
            reason = F.when(fits, why).otherwise(reason)
            confidence = F.when(fits, F.lit(sure).cast("double")).otherwise(confidence)
    return findings.withColumns({
        "prefilter_reason": reason,
        "is_false_positive": F.coalesce(confidence.isNotNull(), F.lit(False)),
        "needs_review": F.coalesce(reason == "code_snippet too short", F.lit(False)),
        "ai_confidence": F.coalesce(confidence, F.col("ai_confidence")) if "ai_confidence" in findings.columns else confidence,
    })


def decided(findings: DataFrame) -> DataFrame:
    """findings with ai_action and ai_reasoning; a missing confidence is tested before it is compared."""
    sure = F.col("ai_confidence")
    shown = F.format_string("%.2f", sure)
    action = (
        F.when(F.col("is_false_positive"), "drop").when(F.col("needs_review"), "needs_review").when(sure.isNull(), "pending_review")
        .when(sure < 0.3, "drop").when(sure < 0.7, "needs_review").otherwise("keep")
    )
    reasoning = (
        F.when(F.col("is_false_positive") | F.col("needs_review"), F.coalesce("prefilter_reason", F.lit("prefilter")))
        .when(sure.isNull(), "not reviewed").when(sure < 0.3, F.concat(F.lit("confidence only "), shown)).when(sure < 0.7, F.concat(F.lit("confidence "), shown))
        .otherwise("kept")
    )
    return findings.withColumns({"ai_action": action, "ai_reasoning": reasoning})


def undropped(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("ai_action").eqNullSafe("drop"))


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """reviews with valid: an id that isn't blank, and a confidence that is missing or a number from 0 to 1."""
    sure = F.col("ai_confidence").try_cast("double")
    ok = F.trim(F.coalesce("issue_id", F.lit(""))) != ""
    return reviews.withColumn("valid", ok & (F.col("ai_confidence").isNull() | F.coalesce(sure.between(0, 1), F.lit(False))))


def merge_reviews(findings: DataFrame, reviews: DataFrame, order: str = "ord") -> DataFrame:
    """findings with the last valid review of their issue_id merged in: ai_action, ai_confidence, ai_reviewed."""
    last = valid_reviews(reviews).where("valid").groupBy("issue_id").agg(F.max_by(F.struct("is_false_positive", "needs_review", "ai_confidence"), order).alias("r"))
    joined = findings.join(last, "issue_id", "left")
    wrong, unsure = F.coalesce("r.is_false_positive", F.lit(False)), F.coalesce("r.needs_review", F.lit(False))
    action = F.when(F.col("r").isNull(), F.col("ai_action")).when(wrong, "drop").when(unsure, "needs_review").otherwise("keep")
    sure = F.when(F.col("r").isNull(), F.col("ai_confidence")).otherwise(F.col("r.ai_confidence").try_cast("double"))
    return joined.withColumns({"ai_action": action, "ai_confidence": sure, "ai_reviewed": F.col("r").isNotNull()}).drop("r")


def upsert(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the matching update, where there is one; the keyed update of a decision log."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")).dropDuplicates([key])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def enrich(findings: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """findings with columns of their rule, the first of its id. rules is the rule dimension."""
    first = rules.groupBy("rule_id").agg(*[F.min_by(c, "rule_ord").alias(c) for c in columns])
    return findings.join(first, "rule_id", "left")


def with_confidence_at_least(findings: DataFrame, thresholds: list[float]) -> DataFrame:
    """findings once for each threshold that their confidence reaches."""
    return findings.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("is_valid and ai_confidence >= threshold")
