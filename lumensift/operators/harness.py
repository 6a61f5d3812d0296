"""Decision logs, feedback and quality: stores of JSON rows that scans append to, and what is read from them."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import aggregates as A
from lumensift.operators.tables import settled

DECISIONS = (
    "issue_id string, rule_id string, file string, line int, severity string, original_message string, ai_action string, ai_confidence double, ai_reasoning string, "
    "ai_evidence array<string>, user_verdict string, user_comment string, verdict_at string, updated_at string, scan_id string, timestamp string, repo string, workflow string, total_issues long"
)
FEEDBACK = "issue_id string, scan_id string, verdict string, comment string, timestamp string"


def session_id(at):
    """A scan session's id in the decision log."""
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")


def decision_rows(findings: DataFrame, scan_id: str, at: str, repo: str, workflow: str) -> DataFrame:
    """findings as entries of the decision log; the session's fields stand in every row, its size is one number."""
    total = findings.count()
    given = {"original_message": F.col("message"), "line": F.coalesce(F.col("line").cast("int"), F.lit(0)), "file": F.coalesce("file", F.lit("")), "rule_id": F.coalesce("rule_id", F.lit("unknown")),
             "severity": F.coalesce("severity", F.lit("UNKNOWN")), "ai_evidence": F.when(F.coalesce("code_snippet", F.lit("")) != "", F.array("code_snippet")).otherwise(F.array().cast("array<string>")),
             "scan_id": F.lit(scan_id), "timestamp": F.lit(at), "repo": F.lit(repo), "workflow": F.lit(workflow), "total_issues": F.lit(total)}
    fields = [part.split(" ", 1) for part in DECISIONS.split(", ")]
    value = lambda name: given.get(name, F.col(name) if name in findings.columns else F.lit(None))
    return findings.select(*[value(name).cast(kind).alias(name) for name, kind in fields])


def log_decisions(decisions: DataFrame, folder: str) -> None:
    """A session's entries, at once: the folder of its scan appears complete or not at all. Another try replaces it."""
    spark = decisions.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        decisions.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("scan_id").json(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_decisions(spark: SparkSession, folder: str, scan_id: str | None = None) -> DataFrame:
    """The entries of all sessions, or of one, whose folder alone is read."""
    rows = spark.read.schema(DECISIONS).json(folder)
    return rows if scan_id is None else rows.where(F.col("scan_id") == scan_id)


def update_decisions(spark: SparkSession, folder: str, updates: DataFrame, at: str) -> None:
    """Entries of the log whose issue_id is in updates (issue_id, ai_action, ai_confidence, ai_reasoning) get what isn't
    null there. Sessions with such entries are rewritten, the others stay as they are."""
    rows = read_decisions(spark, folder)
    new = updates.groupBy("issue_id").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in ("ai_action", "ai_confidence", "ai_reasoning")], F.lit(True).alias("_hit"))
    joined = rows.join(new, "issue_id", "left")
    touched = joined.where("_hit").select("scan_id").distinct()
    joined = joined.join(touched, "scan_id", "left_semi")
    out = joined.withColumns({c: F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)) for c in ("ai_action", "ai_confidence", "ai_reasoning")})
    out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("updated_at")))
    log_decisions(settled(out.select(*rows.columns)), folder)  # written apart first: the log is what it is read from


def workspace(base: str, at, salt: str) -> dict[str, str]:
    """The folders of one scan, made on the driver's file system: report, cache and decisions."""
    scan_id = f"{at:%Y-%m-%d_%H-%M-%S}_{hashlib.md5(salt.encode()).hexdigest()[:4]}"
    out = {"scan_id": scan_id, "workspace": f"{base.rstrip('/')}/{scan_id}"}
    for name in ("report", "cache", "decisions"):
        out[name] = f"{out['workspace']}/{name}"
        Path(out[name]).mkdir(parents=True, exist_ok=True)
    return out


def scans(decisions: DataFrame) -> DataFrame:
    """Ids of the sessions, the latest first."""
    return decisions.select("scan_id").distinct().orderBy(F.desc("scan_id"))


def add_feedback(rows: DataFrame, *folders: str) -> None:
    """Appends to the global store and to the workspace's, a store that is named twice once."""
    fields = [part.split(" ", 1) for part in FEEDBACK.split(", ")]
    rows = rows.select(*[(F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])
    for folder in dict.fromkeys(folders):
        rows.write.mode("append").option("ignoreNullFields", "false").json(folder)


def read_feedback(spark: SparkSession, folder: str, scan_id: str | None = None, issue_id: str | None = None) -> DataFrame:
    """Feedback of all scans or of one, on all issues or on one."""
    rows = spark.read.schema(FEEDBACK).json(folder)
    for name, value in (("scan_id", scan_id), ("issue_id", issue_id)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def sync_feedback(spark: SparkSession, store: str, workspace: str) -> None:
    """The workspace's store becomes a copy of the global one."""
    if store != workspace:
        spark.read.schema(FEEDBACK).json(store).write.mode("overwrite").option("ignoreNullFields", "false").json(workspace)


def pending(decisions: DataFrame, feedback: DataFrame, every: bool = False) -> DataFrame:
    """Decisions that nobody has judged yet; every: all of them."""
    return decisions if every else decisions.join(feedback.select("issue_id").distinct(), "issue_id", "left_anti")


def overall(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: total_decisions, total_feedbacks, total_with_feedback, correct, incorrect, accuracy; an issue's last feedback counts."""
    counted = A.accuracy(A.judged(decisions, feedback, ["issue_id"], "timestamp"))
    sizes = decisions.agg(F.count(F.lit(1)).alias("total_decisions")).crossJoin(feedback.agg(F.count(F.lit(1)).alias("total_feedbacks")))  # one row each
    return sizes.crossJoin(counted)


def by_rule(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """accuracy of each rule with any feedback; feedback counts for decisions of its own scan."""
    return A.accuracy(A.judged(decisions, feedback, ["scan_id", "issue_id"], "timestamp"), "rule_id")


def quality_lines(total: DataFrame, rules: DataFrame) -> DataFrame:
    """(section, rank, n, txt): the quality report, its rules by ascending accuracy. total: one row, rules: a row per rule."""
    bar = F.lit("=" * 60)
    s = lambda c: F.col(c).cast("string")
    head = F.array(
        bar, F.lit("AI 评审质量统计报告"), bar, F.lit(""), F.lit("总体统计:"), F.concat(F.lit("  总决策数: "), s("total_decisions")), F.concat(F.lit("  总反馈数: "), s("total_feedbacks")),
        F.concat(F.lit("  有反馈的决策: "), s("total_with_feedback")), F.concat(F.lit("  正确判断: "), s("correct")), F.concat(F.lit("  错误判断: "), s("incorrect")),
        F.concat(F.lit("  准确率: "), T.percent(F.col("accuracy"))), F.lit(""),
    )
    top = total.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("rank"), F.posexplode(head).alias("n", "txt"))
    title = rules.limit(1).select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("n"), F.lit("按规则统计:").alias("txt"))
    ranked = rules.withColumn("rank", F.row_number().over(Window.orderBy("accuracy", "rule_id")).cast("long"))  # the rule dimension
    line = F.concat(F.lit("    准确率: "), T.percent(F.col("accuracy")), F.lit(" ("), s("correct"), F.lit("/"), s("total_with_feedback"), F.lit(")"))
    each = ranked.select(F.lit(1).alias("section"), "rank", F.posexplode(F.array(F.concat(F.lit("  "), "rule_id", F.lit(":")), line)).alias("n", "txt"))
    return top.unionByName(title).unionByName(each)


def stats_cache(total: DataFrame, rules: DataFrame, at: str) -> DataFrame:
    """One JSON document of the figures, as the cache holds it; the rule dimension is in it."""
    figures = F.struct(F.col("total_with_feedback").alias("total"), "correct", "incorrect", "accuracy")
    listed = rules.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", figures)))).alias("by_rule"))
    return total.select(F.struct("*").alias("overall")).crossJoin(listed).select(F.to_json(F.struct(F.lit(at).alias("generated_at"), "overall", "by_rule")).alias("value"))  # one row each


def recent_examples(feedback: DataFrame, decisions: DataFrame, most: int = 10) -> DataFrame:
    """The latest feedback with the rule that it is about (unknown without a decision), the latest first."""
    last = feedback.orderBy(F.desc("timestamp"), "issue_id").limit(most)
    rules = decisions.groupBy("issue_id").agg(F.max("rule_id").alias("rule_id"))
    return last.join(rules, "issue_id", "left").withColumn("rule_id", F.coalesce("rule_id", F.lit("unknown"))).orderBy(F.desc("timestamp"), "issue_id")
