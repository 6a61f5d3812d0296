"""Queries that render reports, tasks and notifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import aggregates as A
from lumensift.operators import findings as N
from lumensift.operators import report as R
from lumensift.plans.data import FEEDBACK_CTE, FINDINGS_CTE, TRIAGE_CTE, feedback, findings, stored_findings, table
from lumensift.plans.findings import ACCURACY, LEVEL, _decided, _judged
from lumensift.plans.registry import query


@query(f"WITH {TRIAGE_CTE} SELECT count(*) AS total, count(*) FILTER ({LEVEL} = 'critical') AS critical, count(*) FILTER ({LEVEL} = 'high') AS high, count(*) FILTER (ai_action = 'drop') AS dropped, (SELECT rule_id FROM findings GROUP BY 1 ORDER BY count(*) DESC, min(ord) LIMIT 1) AS top_rule FROM decided")
def report_json(spark, sf_dir):
    """The nested report as JSON, read back: key order and spacing differ between engines, values don't."""
    base = stored_findings(spark, sf_dir, "rule_id", "file", "severity", "category", "code_snippet", "ai_confidence", "ord")
    found = N.decided(N.prefilter(base))
    level = T.reported_severity(F.col("severity"), F.col("category"))
    counts = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(level == "critical").alias("critical"), F.count_if(level == "high").alias("high"), F.count_if(F.col("ai_action") == "drop").alias("dropped"))
    best = A.top(base, "rule_id", "ord", 1).select(F.col("rule_id").alias("top_rule"))
    one = counts.crossJoin(best)  # one row each
    report = one.select(F.to_json(F.struct(F.struct("total", "critical", "high").alias("summary"), F.create_map(F.lit("drop"), "dropped").alias("by_action"), "top_rule")).alias("json"))
    read = report.select(F.from_json("json", "summary struct<total:long,critical:long,high:long>, by_action map<string,long>, top_rule string").alias("r"))
    return read.select("r.summary.total", "r.summary.critical", "r.summary.high", F.col("r.by_action")["drop"].alias("dropped"), "r.top_rule")


_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'INFO' THEN 2 ELSE 1 END, file, ord)::INT AS rank FROM decided)"
_ICON = "CASE severity WHEN 'ERROR' THEN '🔴' WHEN 'WARNING' THEN '🟡' WHEN 'INFO' THEN '🔵' ELSE '⚪' END"
_BADGE = "CASE ai_action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.BADGES.items()) + " END"


@query(f"""WITH {TRIAGE_CTE}, {_RANKED}, l AS (SELECT rank, ['### ' || rank || '. ' || {_ICON} || ' [' || rule_id || '] ' || {_BADGE}, '', '- **文件**: `' || file || '`', '- **行号**: ' || line, '- **严重等级**: ' || severity, '- **类别**: ' || category, '- **描述**: ' || message, ''] AS ls FROM ranked)
    SELECT rank, (generate_subscripts(ls, 1) - 1)::INT AS n, unnest(ls) AS txt FROM l""")
def report_markdown_lines(spark, sf_dir):
    """The finding part of the Markdown report, of all findings."""
    every = R.ranked(_decided(spark, sf_dir))
    return R.finding_lines(every.withColumn("rank", F.col("rank").cast("int")))


@query(f"""WITH {TRIAGE_CTE}, {FEEDBACK_CTE}, a AS (SELECT rule_id, {ACCURACY} FROM decided JOIN feedback USING (doc_id) GROUP BY rule_id), p AS (SELECT *, round(accuracy * 1000)::INT AS m, row_number() OVER (ORDER BY accuracy, rule_id)::INT AS rank FROM a)
    SELECT rank, rule_id, '    准确率: ' || (m // 10) || '.' || (m % 10) || '% (' || correct || '/' || total_with_feedback || ')' AS txt FROM p""")
def quality_report_lines(spark, sf_dir):
    by_rule = A.accuracy(_judged(spark, sf_dir), "rule_id")  # a row per rule: the rule dimension
    line = F.concat(F.lit("    准确率: "), T.percent(F.col("accuracy")), F.lit(" ("), F.col("correct").cast("string"), F.lit("/"), F.col("total_with_feedback").cast("string"), F.lit(")"))
    return by_rule.select(F.row_number().over(Window.orderBy("accuracy", "rule_id")).alias("rank"), "rule_id", line.alias("txt"))


@query(f"""WITH {FEEDBACK_CTE}, s AS (SELECT count(*) AS total, count(*) FILTER (verdict = 'confirmed') AS c, count(*) FILTER (verdict = 'false_positive') AS f, count(*) FILTER (verdict = 'uncertain') AS u FROM feedback),
    m AS (SELECT *, round(CASE WHEN total > 0 THEN c / total::DOUBLE ELSE 0 END * 1000)::INT AS m FROM s)
    SELECT '- 总反馈数: ' || total || chr(10) || '- 确认（真实问题）: ' || c || chr(10) || '- 误报: ' || f || chr(10) || '- 不确定: ' || u || chr(10) || '- 历史准确率: ' || (m // 10) || '.' || (m % 10) || '%' AS task FROM m""")
def review_task_text(spark, sf_dir):
    s = A.feedback_summary(feedback(spark, sf_dir))
    share = T.percent(A.ratio(F.col("confirmed"), F.col("total"), 12))
    return s.select(F.concat_ws("\n", *[F.concat(F.lit(label), F.col(c).cast("string")) for label, c in (("- 总反馈数: ", "total"), ("- 确认（真实问题）: ", "confirmed"), ("- 误报: ", "false_positive"), ("- 不确定: ", "uncertain"))], F.concat(F.lit("- 历史准确率: "), share)).alias("task"))


@query("SELECT event_id, 'scan.complete' AS event, 'success' AS status, 'scan.failure' AS inner_event, event_type FROM events WHERE event_type = 'error'")
def alert_envelope(spark, sf_dir):
    """Alerts go out as the data of a success notification; the payload is read back from its JSON."""
    alerts = table(spark, sf_dir, "events").where("event_type = 'error'")
    data = F.struct(F.lit("scan.failure").alias("event"), F.col("event_type").alias("error_type"), F.col("event_id").alias("id"))
    sent = alerts.select(R.envelope(F.lit("scan.complete"), F.col("ts").cast("string"), F.lit("success"), data).alias("payload"))
    read = sent.select(F.from_json("payload", "event string, timestamp string, status string, data struct<event:string,error_type:string,id:long>").alias("p"))
    return read.select(F.col("p.data.id").alias("event_id"), "p.event", "p.status", F.col("p.data.event").alias("inner_event"), F.col("p.data.error_type").alias("event_type"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || left(md5(event_id::VARCHAR), 4) AS scan_id FROM events WHERE event_type = 'signup'")
def workspace_scan_id(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return events.select("event_id", R.workspace_id(F.col("ts").cast("timestamp"), F.col("event_id").cast("string")).alias("scan_id"))


@query(f"WITH {FINDINGS_CTE} SELECT file, line, max(CASE severity WHEN 'ERROR' THEN 0 WHEN 'INFO' THEN 2 ELSE 1 END)::INT AS rank, count(*) AS n FROM findings GROUP BY ALL")
def findings_per_line(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("file", "line").agg(F.max(T.severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("n"))
