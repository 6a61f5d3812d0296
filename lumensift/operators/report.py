"""Reports as rows: nested JSON, Markdown lines, and the sinks that write them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import aggregates as A
from lumensift.operators.findings import numbered_by

# What a report shows for severities and actions.
ICONS = {"ERROR": "🔴", "WARNING": "🟡", "INFO": "🔵"}
BADGES = {"drop": "🚫 已丢弃（误报）", "needs_review": "⚠️ 待人工确认", "pending_review": "🤖 待 AI 评审", "keep": "✅ 保留"}
STYLES = {"drop": " (灰色背景)", "needs_review": " (黄色高亮)"}
VERDICTS = {"confirmed": "用户确认（真实问题）", "false_positive": "用户标记为误报", "uncertain": "用户不确定"}


def _pick(column: Column, table: dict[str, str], otherwise: Column) -> Column:
    for key, value in table.items():
        otherwise = F.when(column == key, value).otherwise(otherwise)
    return otherwise


def badge(action: Column) -> Column:
    return _pick(F.coalesce(action, F.lit("pending_review")), BADGES, F.col("ai_action"))


def heading(rank: Column) -> Column:
    icon = _pick(F.coalesce("severity", F.lit("WARNING")), ICONS, F.lit("⚪"))
    return F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), icon, F.lit(" ["), F.col("rule_id"), F.lit("] "), badge(F.col("ai_action")))


def finding_lines(findings: DataFrame) -> DataFrame:
    """(rank, n, txt): the Markdown lines of each finding; findings have rank, rule_id, file, line, severity, category, ai_action, message."""
    body = F.array(
        heading(F.col("rank")), F.lit(""), F.concat(F.lit("- **文件**: `"), "file", F.lit("`")), F.concat(F.lit("- **行号**: "), F.col("line").cast("string")),
        F.concat(F.lit("- **严重等级**: "), "severity"), F.concat(F.lit("- **类别**: "), "category"), F.concat(F.lit("- **描述**: "), "message"), F.lit(""),
    )
    return findings.select("rank", F.posexplode(body).alias("n", "txt"))


def full_finding_lines(findings: DataFrame) -> DataFrame:
    """(rank, n, txt): all that the report says of each ranked finding; what a finding lacks has no line.

    Besides what finding_lines needs, findings may have code_snippet, fix, call_chain (array of strings, or of structs
    name, file, line) and metadata (a map with cwe and owasp).
    """
    has = set(findings.columns)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in has else F.lit("N/A")
    action = badge(F.col("ai_action"))
    style = _pick(F.col("ai_action"), STYLES, F.lit(""))
    groups = [F.array(
        heading(F.col("rank")), F.lit(""), F.concat(F.lit("- **文件**: `"), shown("file"), F.lit("`")), F.concat(F.lit("- **行号**: "), shown("line")),
        F.concat(F.lit("- **严重等级**: "), shown("severity")), F.concat(F.lit("- **类别**: "), shown("category")), F.concat(F.lit("- **AI 决策**: "), action, style),
        F.concat(F.lit("- **描述**: "), shown("message")),
    )]
    none = F.array().cast("array<string>")
    if "code_snippet" in has:
        block = F.concat(F.array(F.lit("- **代码片段**:"), F.lit("  ```")), F.split(F.concat(F.lit("  "), T.stripped(F.col("code_snippet"))), "\n", -1), F.array(F.lit("  ```")))
        groups.append(F.when(F.coalesce("code_snippet", F.lit("")) != "", block).otherwise(none))
    if "fix" in has:
        groups.append(F.when(F.coalesce("fix", F.lit("")) != "", F.split(F.concat(F.lit("- **修复建议**: "), "fix"), "\n", -1)).otherwise(none))
    if "call_chain" in has:
        item = findings.schema["call_chain"].dataType.elementType
        own = lambda c, f: F.coalesce(c[f].cast("string"), F.lit("?"))
        told = F.transform("call_chain", lambda c: F.concat(own(c, "name"), F.lit("@"), own(c, "file"), F.lit(":"), own(c, "line")) if item.typeName() == "struct" else c.cast("string"))
        groups.append(F.when(F.size("call_chain") > 0, F.array(F.concat(F.lit("- **调用链**: "), F.array_join(told, " → ")))).otherwise(none))
    if "metadata" in has:
        of = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
        groups.append(F.when((of("cwe") != "") | (of("owasp") != ""), F.array(F.rtrim(F.concat(F.lit("- **安全标准**: "), of("cwe"), F.lit(" "), of("owasp"))))).otherwise(none))
    return findings.select("rank", F.posexplode(F.concat(*groups, F.array(F.lit("")))).alias("n", "txt"))


def summary(findings: DataFrame, order: str = "ord", first: int = 20) -> DataFrame:
    """One row: total, critical, high, medium, low, and by_category, by_file, by_rule, by_action as arrays of (name, n),
    the most frequent ones first; of files and rules the first ones, as the report has them."""
    kept = findings.select(order, "severity", *[F.coalesce(c, F.lit(m)).alias(c) for c, m in (("category", "unknown"), ("file", "unknown"), ("rule_id", "unknown"), ("ai_action", "pending_review"))])
    out = A.severity_summary(kept)
    for name, column, most in (("by_category", "category", None), ("by_file", "file", first), ("by_rule", "rule_id", first), ("by_action", "ai_action", None)):
        counts = kept.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
        counts = counts.orderBy(F.desc("n"), "_o").limit(most) if most else counts  # categories and actions are few
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_n"), F.col("_o"), "name", "n")))
        out = out.crossJoin(counts.agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias(name)))  # one row each
    return out


def _lines(section: int, columns: DataFrame, txt: Column) -> DataFrame:
    return columns.select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("rank"), F.posexplode(txt).alias("n", "txt"))


def report_lines(findings: DataFrame, counts: DataFrame, scan: dict, diff: dict, graph: dict, now: str) -> DataFrame:
    """(section, rank, n, txt): the whole Markdown report in order of these columns.

    findings are ranked, counts is their summary. scan: timestamp, duration_seconds, repo, base_branch, target_branch,
    profile; diff: files_changed, insertions, deletions; graph: node_count, edge_count, affected.
    """
    said = lambda k: str(scan.get(k, "N/A"))
    head = ["# 代码评审报告", "", f"**生成时间**: {said('timestamp')}", f"**扫描耗时**: {said('duration_seconds')}s", "", "## 扫描信息", "", "| 项目 | 值 |", "|------|-----|"]
    head += [f"| {label} | `{said(k)}` |" for label, k in (("仓库", "repo"), ("基线分支", "base_branch"), ("目标分支", "target_branch"), ("规约 Profile", "profile"))]
    head += ["", "## 变更统计", ""] + [f"- {label}: **{diff.get(k, 0)}**" for label, k in (("变更文件数", "files_changed"), ("新增行数", "insertions"), ("删除行数", "deletions"))] + [""]
    if graph.get("node_count", 0) > 0:
        head += ["## 调用图分析", ""] + [f"- {label}: **{graph.get(k, 0)}**" for label, k in (("调用图节点", "node_count"), ("调用边", "edge_count"), ("受影响方法", "affected"))] + [""]
    head += ["## 问题摘要", "", "| 严重等级 | 数量 |", "|----------|------|"]
    s = lambda c: F.col(c).cast("string")
    rows = [F.concat(F.lit(f"| {c.upper()} | "), s(c), F.lit(" |")) for c in ("critical", "high", "medium", "low")]
    table = F.array(*[F.lit(x) for x in head], *rows, F.concat(F.lit("| **总计** | **"), s("total"), F.lit("** |")), F.lit(""))
    kinds = F.transform("by_category", lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), x["n"].cast("string"), F.lit(" |")))
    kinds = F.when(F.size("by_category") > 0, F.concat(F.array(*map(F.lit, ["### 按类别分布", "", "| 类别 | 数量 |", "|------|------|"])), kinds, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    top = _lines(0, counts, F.concat(table, kinds, F.array(F.lit("## 详细问题列表"), F.lit(""))))
    body = full_finding_lines(findings).select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("rank"), "n", "txt")
    foot = _lines(2, counts, F.array(F.lit("---"), F.lit(f"*报告由代码评审工具自动生成 | {now}*")))
    return top.unionByName(body).unionByName(foot)


def summary_json(counts: DataFrame) -> DataFrame:
    """(value): the summary as a JSON object whose parts are objects by name, in their order."""
    return counts.select(_summary_object().alias("value"))


def _object(pairs: str) -> Column:
    each = F.transform(pairs, lambda x: F.concat(_quoted(x["name"]), F.lit(": "), x["n"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _summary_object() -> Column:
    numbers = [F.concat(F.lit(f'"{c}": '), F.col(c).cast("string")) for c in ("total", "critical", "high", "medium", "low")]
    parts = [F.concat(F.lit(f'"{c}": '), _object(c)) for c in ("by_category", "by_file", "by_rule", "by_action")]
    return F.concat(F.lit("{"), F.concat_ws(", ", *numbers, *parts), F.lit("}"))


def report_json_lines(findings: DataFrame, counts: DataFrame, scan: dict, diff: dict, graph: dict, affected: DataFrame | None = None) -> DataFrame:
    """(section, rank, n, txt): the nested report as lines that are one JSON document in order of these columns.

    An issue is a line, and so is an affected method, so that no row and no task ever holds all of them. findings are
    ranked; affected: (affected), one row per method.
    """
    head = F.concat(F.lit('{"scan_info": ' + json.dumps(scan, ensure_ascii=False) + ', "summary": '), _summary_object(), F.lit(', "diff_summary": ' + json.dumps({k: diff.get(k, 0) for k in ("files_changed", "insertions", "deletions")}) + ', "call_graph_summary": {' + ", ".join(f'"{k}": {json.dumps(graph.get(k, 0))}' for k in ("node_count", "edge_count")) + ', "affected_methods": ['))
    out = _lines(0, counts, F.array(head))
    if affected is not None:
        names = numbered_by(affected, F.col("affected"), start=1)
        out = out.unionByName(names.select(F.lit(1).alias("section"), F.col("number").alias("rank"), F.lit(0).alias("n"), F.concat(F.when(F.col("number") > 1, F.lit(",")).otherwise(F.lit("")), _quoted(F.col("affected"))).alias("txt")))
    out = out.unionByName(_lines(2, counts, F.array(F.lit(']}, "issues": ['))))
    issue = F.to_json(F.struct(*[c for c in findings.columns if c != "rank"]), {"ignoreNullFields": "false"})
    rows = findings.select(F.lit(3).alias("section"), F.col("rank").cast("long").alias("rank"), F.lit(0).alias("n"), F.concat(F.when(F.col("rank") > 1, F.lit(",")).otherwise(F.lit("")), issue).alias("txt"))
    return out.unionByName(rows).unionByName(_lines(4, counts, F.array(F.lit("]}"))))


def engine_json(findings: DataFrame, files_scanned: int, seconds: float, rules: int) -> DataFrame:
    """(section, rank, n, txt): the syntax engine's output, issues a line each, with counts by severity and by rule."""
    found = findings.withColumn("_one", F.lit(1))
    counts = found.agg(F.count(F.lit(1)).alias("total"))
    for name, column in (("by_severity", "severity"), ("by_rule", "rule_id")):
        own = found.groupBy(F.coalesce(column, F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        order = F.struct("name", "n") if name == "by_severity" else F.struct((-F.col("n")).alias("_n"), "name", "n")
        listed = F.array_sort(F.collect_list(order))
        counts = counts.crossJoin(own.agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias(name)))  # one row each
    numbered = numbered_by(findings, F.col("file"), F.col("line"), F.col("rule_id"), start=1)
    issue = F.to_json(F.struct(*findings.columns))
    rows = numbered.select(F.lit(1).alias("section"), F.col("number").alias("rank"), F.lit(0).alias("n"), F.concat(F.when(F.col("number") > 1, F.lit(",")).otherwise(F.lit("")), issue).alias("txt"))
    stats = F.concat(F.lit('], "stats": {' + f'"files_scanned": {files_scanned}, "total_time": {seconds}, "rules_count": {rules}, "total_issues": '), F.col("total").cast("string"), F.lit(', "by_severity": '), _object("by_severity"), F.lit(', "by_rule": '), _object("by_rule"), F.lit("}}"))
    return _lines(0, counts, F.array(F.lit('{"issues": ['))).unionByName(rows).unionByName(_lines(2, counts, F.array(stats)))


def rule_test_report(verdicts: DataFrame) -> DataFrame:
    """(total, passed, failed, results) of rule test cases with their verdicts: a list of hand-written cases."""
    listed = F.array_sort(F.collect_list(F.struct("source_file", "case_id", "title", "language", "is_violation", "expected", "actual", "passed")))
    return verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), listed.alias("results"))


def task_lines(findings: DataFrame, changed: DataFrame, contract: str, params: dict, prompt: str, feedback: dict | None = None, examples: list[tuple[str, str, str | None]] = ()) -> DataFrame:
    """(section, rank, n, txt): the review task. Findings to review are a line each; of the changed files (path, ord) the
    task names the first ten, of examples (rule, verdict, comment) the first five. Without findings it is empty."""
    one = findings.limit(1).select(F.lit(1).alias("_one"))
    top = [*contract.split("\n"), "", "## LLM 调用参数（必须使用以下参数调用 LLM）", "```json", *json.dumps(params, ensure_ascii=False, indent=2).split("\n"), "```", "", "---", "", *prompt.split("\n"), "", "## 评审数据", ""]
    n = findings.agg(F.count(F.lit(1)).alias("total"))
    out = _lines(0, one.crossJoin(n), F.concat(F.array(*map(F.lit, top)), F.array(F.concat(F.lit("### 扫描结果（共 "), F.col("total").cast("string"), F.lit(" 条）")), F.lit("["))))  # one row each
    issue = F.to_json(F.struct(*[c for c in findings.columns if c != "rank"]))
    out = out.unionByName(findings.select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("rank"), F.lit(0).alias("n"), F.concat(F.when(F.col("rank") > 1, F.lit(",")).otherwise(F.lit("")), issue).alias("txt")))
    first = changed.orderBy("ord").limit(10).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
    tail = [""]
    if feedback and feedback.get("total"):
        share = round(1000 * feedback["confirmed"] / feedback["total"]) / 10
        tail += ["## 历史反馈统计", "基于过去的评审数据："] + [f"- {label}: {feedback[k]}" for label, k in (("总反馈数", "total"), ("确认（真实问题）", "confirmed"), ("误报", "false_positive"), ("不确定", "uncertain"))] + [f"- 历史准确率: {share:.1f}%", ""]
        if examples:
            tail.append("### 近期反馈示例")
            tail += [f"- 规则 `{rule}`: {VERDICTS.get(verdict, verdict)}" + (f"（{comment}）" if comment else "") for rule, verdict, comment in examples[:5]]
    listed = F.concat(F.array(F.lit("]"), F.lit(""), F.lit("### 变更文件"), F.to_json("paths")), F.array(*map(F.lit, tail)))
    return out.unionByName(_lines(2, one.crossJoin(first), listed))  # one row each


def ranked(findings: DataFrame, first: int | None = None) -> DataFrame:
    """findings by severity, file, then arrival; the rank column makes the order part of the result.

    first: only so many, found by a top-k and not by a full sort.
    """
    order = [T.severity_rank(F.col("severity")), F.col("file"), F.col("ord")]
    if first is not None:
        findings = findings.orderBy(*order).limit(first)
        return findings.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered_by(findings, *order, start=1).withColumnRenamed("number", "rank")


def summary_struct(total: Column, **parts: Column) -> Column:
    return F.struct(total.alias("total"), *[c.alias(k) for k, c in parts.items()])


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """The report, summary, decision and cache sinks: JSON files, partitioned by scan where asked."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def write_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """Markdown in order: files sort by name, and rows by order across them."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("txt").write.mode("overwrite").text(path)


def append_feedback(feedback: DataFrame, *paths: str) -> None:
    """The global and the workspace copy, both appended to."""
    for path in paths:
        feedback.write.mode("append").parquet(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review results: files with a list, or with a list under ``results``."""
    row = "issue_id string, is_false_positive boolean, ai_confidence string, analysis string, enhanced_fix string, needs_review boolean, reviewed_at string"
    raw = spark.read.text(path, wholetext=True)
    item = f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in row.split(', '))}>>"
    plain, nested = F.from_json("value", item), F.from_json("value", f"struct<results:{item}>")["results"]
    both = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(nested, F.array().cast(item)))
    return raw.select(F.posexplode(both).alias("ord", "r")).select("ord", "r.*")


def envelope(event: Column, at: Column, status: Column, data: Column) -> Column:
    return F.to_json(F.struct(event.alias("event"), at.alias("timestamp"), status.alias("status"), data.alias("data")))


def workspace_id(at: Column, salt: Column) -> Column:
    """``yyyy-MM-dd_HH-mm-ss_`` and the first four digits of an MD5."""
    return F.concat_ws("_", F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), F.left(F.md5(salt), F.lit(4)))
