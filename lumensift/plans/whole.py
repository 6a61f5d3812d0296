"""Queries on the scan as a whole: rule files, syntax, graphs, harness and complete reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.operators import aggregates as A
from lumensift.operators import findings as N
from lumensift.operators import graph as G
from lumensift.operators import harness as H
from lumensift.operators import report as R
from lumensift.operators import rulebase
from lumensift.operators.match import scan_texts
from lumensift.operators.scan import scan
from lumensift.operators.syntax import engine_scan
from lumensift.plans.data import CODE, FEEDBACK_CTE, RULE_FILES, TRIAGE_CTE, feedback, stored_findings, table, values
from lumensift.plans.findings import LEVEL, RULE_CASES, RULE_HITS, cache_status
from lumensift.plans.registry import query
from lumensift.sources import code as C
from lumensift.sources import diff, rules_md

SCANNED = [
    ("src/Dao.java", "java", 'class Dao {\n  void a() {\n    stmt.execute(q\n      + name);\n    stmt.execute("x" + y);\n    stmt.execute(a + b);  stmt.execute(c + d);\n  }\n}\n'),
    ("lib/job.py", "python", "try:\n    db.execute(q + name)\nexcept:\n    pass\nclass lower:\n    pass\n"),
    ("web/a.js", "javascript", "stmt.execute(q + name);\nexcept:\n"),
]
SCAN_RULES = [*RULE_FILES, ("custom/regex.md", "# Regex wins\n\n```yaml\nid: custom-last\nlanguages: []\nseverity: INFO\n```\n\n```pattern\nnever(...)\n```\n\n```pattern-regex\nno such text\n```\n\n```pattern-regex\npass\\s*\\n\n```\n")]
#: Worked out by hand: which rule finds what, and where. The rule on names is switched off.
SCAN_EXPECTED = [
    ("sqli-demo", "security", "ERROR", "src/Dao.java", 3, 7, "stmt.execute(q\n      + name)"), ("sqli-demo", "security", "ERROR", "src/Dao.java", 6, 9, "stmt.execute(a + b)"),
    ("sqli-demo", "security", "ERROR", "src/Dao.java", 6, 9, "stmt.execute(c + d)"), ("sqli-demo", "security", "ERROR", "lib/job.py", 2, 6, "db.execute(q + name)"),
    ("err-demo", "implementation", "WARNING", "lib/job.py", 3, 7, "except:"), ("custom-last", "custom", "INFO", "lib/job.py", 4, 7, "pass\n"), ("custom-last", "custom", "INFO", "lib/job.py", 6, 7, "pass\n"),
]


def _rules(spark):
    found = [r for _, text in SCAN_RULES for r in rules_md.parse(text) if r.enabled is not False]
    return rulebase.compiled(found, spark)


@query("SELECT rule_id, category, severity, file, line::INT AS line, end_line::INT AS end_line, matched FROM " + values(SCAN_EXPECTED, "rule_id, category, severity, file, line, end_line, matched"))
def corpus_scan(spark, sf_dir):
    """Rules from Markdown against whole files: every match of every rule."""
    files = spark.createDataFrame(SCANNED, "path string, lang string, text string")
    return scan_texts(files, _rules(spark)).select("rule_id", "category", "severity", "file", "line", "end_line", "matched")


TREE_CODE = """package demo;
// Runtime.getRuntime().exec("not this one");
public class Gate {
    public Document load(HttpServletRequest request) throws Exception {
        DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
        return f.newDocumentBuilder().parse(new File(root, request.getParameter("name")));
    }
    Document safe(InputStream in) throws Exception {
        DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
        f.setFeature("disallow-doctype-decl", true);
        return f.newDocumentBuilder().parse(in);
    }
    boolean check(int apiVersion, byte[] data) {
        if (apiVersion >= 3) {
            return true;
        }
        if (apiVersion < 2) { return verify(data); }
        Signature s = Signature.getInstance("MD5withRSA");
        Runtime.getRuntime().exec(command);
        return new SecretKeySpec("abc".getBytes(), "AES") != new SecretKeySpec(data, NAME);
    }
}
"""
TREE_FILES = [("src/Gate.java", "java", TREE_CODE), ("conf/map.xml", "xml", "<q>\nselect ${id}\n</q>\n"), ("lib/a.py", "python", "password = 'hunter22'\nopen('../x')\nid = '${id}'\n")]
#: Worked out by hand.
TREE_EXPECTED = [
    ("xxe-java-document-builder-usage", "ERROR", "src/Gate.java", 5, 5, "CWE-611"), ("path-traversal-file-ops", "ERROR", "src/Gate.java", 6, 6, "CWE-22"), ("path-traversal-file-ops", "ERROR", "src/Gate.java", 6, 6, "CWE-22"),
    ("sig-bypass-version-skip", "CRITICAL", "src/Gate.java", 14, 16, "CWE-345"), ("sig-java-weak-algorithm", "ERROR", "src/Gate.java", 18, 18, "CWE-328"), ("priv-java-runtime-exec", "ERROR", "src/Gate.java", 19, 19, "CWE-78"),
    ("sig-java-hardcoded-key", "ERROR", "src/Gate.java", 20, 20, "CWE-798"), ("sig-bypass-version-check-regex", "WARNING", "src/Gate.java", 14, 14, "CWE-345"), ("sig-bypass-version-check-regex", "WARNING", "src/Gate.java", 17, 17, "CWE-345"),
    ("sqli-mybatis-dollar", "ERROR", "conf/map.xml", 2, 2, "CWE-89"), ("hardcoded-password", "ERROR", "lib/a.py", 1, 1, "CWE-798"), ("path-traversal-pattern", "WARNING", "lib/a.py", 2, 2, "CWE-22"),
]


def _tree(spark):
    return engine_scan(spark.createDataFrame(TREE_FILES, "path string, lang string, text string"))


@query("SELECT rule_id, severity, file, line::INT AS line, end_line::INT AS end_line, cwe FROM " + values(TREE_EXPECTED, "rule_id, severity, file, line, end_line, cwe"))
def syntax_rules(spark, sf_dir):
    return _tree(spark).select("rule_id", "severity", "file", "line", "end_line", "cwe")


@query("SELECT 1 AS section, row_number() OVER (ORDER BY count(*) DESC, rule_id)::INT AS rank, rule_id AS name, count(*) AS n FROM " + values(TREE_EXPECTED, "rule_id, severity, file, line, end_line, cwe") + " GROUP BY rule_id UNION ALL SELECT 0, row_number() OVER (ORDER BY severity)::INT, severity, count(*) FROM " + values(TREE_EXPECTED, "rule_id, severity, file, line, end_line, cwe") + " GROUP BY severity")
def engine_report(spark, sf_dir):
    """The syntax engine's JSON output, read back: severities by name, rules by how often they hit."""
    lines = R.engine_json(_tree(spark), 3, 0.5, 10)
    stats = lines.where("section = 2").select(F.from_json(F.regexp_replace("txt", r"^\], ", "{"), "stats struct<by_severity:map<string,long>,by_rule:map<string,long>>")["stats"].alias("s"))
    each = lambda c, n: stats.select(F.lit(n).alias("section"), F.posexplode(F.map_entries(f"s.{c}")).alias("rank", "e"))
    both = each("by_severity", 0).unionByName(each("by_rule", 1))
    return both.select("section", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.key").alias("name"), F.col("e.value").alias("n"))


@query("SELECT file, count(*) AS n, count(DISTINCT rule_id) AS n_rules FROM (SELECT DISTINCT file, line, rule_id FROM (SELECT rule_id, file, line FROM " + values(SCAN_EXPECTED, "rule_id, category, severity, file, line, end_line, matched") + " UNION ALL SELECT rule_id, file, line FROM " + values(TREE_EXPECTED, "rule_id, severity, file, line, end_line, cwe", "u") + ")) GROUP BY file")
def scan_fused(spark, sf_dir):
    """Both engines over their files: one finding for each file, line and rule."""
    schema = "path string, lang string, text string"
    found = scan(spark.createDataFrame(SCANNED, schema), _rules(spark), spark.createDataFrame(TREE_FILES, schema))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("n_rules"))


CHANGED_EXPECTED = [("src/Service.java", "process", 3, 23), ("src/Service.java", "validate", 9, 29), ("src/Service.java", "transform", 15, 35), ("src/Service.java", "save", 19, 39), ("lib/load.py", "load", 4, 34), ("lib/load.py", "read", 8, 38), ("lib/load.py", "parse", 12, 42), ("web/app.js", "render", 1, 26), ("web/app.js", "draw", 4, 29), ("web/app.js", "paint", 5, 30), ("web/c.ts", "Shape", 1, 26)]


@query("SELECT path, name, line::INT AS line, end_line::INT AS end_line FROM " + values(CHANGED_EXPECTED, "path, name, line, end_line") + " WHERE path <> 'src/Service.java' OR name <> 'if'")
def diff_method_defs(spark, sf_dir):
    files = spark.createDataFrame([*CODE, ("web/c.ts", "typescript", "class Shape {}\n")], "path string, lang string, text string")
    return C.changed_defs(files).where("name <> 'if'")


STATS = [("s1", " src/A.java | 4 ++--\n lib/b.py   | 1 +\n 2 files changed, 3 insertions(+), 2 deletions(-)\n"), ("s2", " README.md => doc.md | 0\n"), ("s3", "")]


@query("SELECT diff_id, trim(string_split(l, '|')[1]) AS path, 'modified' AS status, 0 AS additions, 0 AS deletions FROM (SELECT diff_id, unnest(string_split(stat, chr(10))) AS l FROM " + values(STATS, "diff_id, stat") + ") WHERE contains(l, '|')")
def diff_stat_files(spark, sf_dir):
    return diff.stat_files(spark.createDataFrame(STATS, "diff_id string, stat string"))


# a conversation is a file, a turn is a line: methods of whole graphs
METHODS_CTE = "m AS (SELECT conv_id::VARCHAR AS file, role || turn AS name, (turn // 2)::INT AS line, turn AS ord FROM conversations)"


def _methods(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("file"), F.concat("role", "turn").alias("name"), F.expr("cast(turn div 2 as int)").alias("line"), F.col("turn").alias("ord"))


@query(f"WITH {METHODS_CTE} SELECT file || ':' || line AS id, arg_min(name, ord) AS name FROM m GROUP BY file, line")
def graph_nodes(spark, sf_dir):
    return G.whole_graph(_methods(spark, sf_dir))[0].select("id", "name")


@query(f"WITH {METHODS_CTE}, e AS (SELECT file || ':' || line AS src, lead(file || ':' || line) OVER (PARTITION BY file ORDER BY ord) AS dst FROM m) SELECT src, dst FROM e WHERE dst IS NOT NULL")
def graph_edges(spark, sf_dir):
    return G.whole_graph(_methods(spark, sf_dir))[1].select(F.col("from").alias("src"), F.col("to").alias("dst"))


@query(f"WITH {METHODS_CTE}, d AS (SELECT DISTINCT file, line FROM m) SELECT d.file || ':' || d.line AS id, count(*) AS callers, string_agg(p.name, '|' ORDER BY p.line, p.name) AS names FROM d JOIN m p ON p.file = d.file AND p.line < d.line GROUP BY 1")
def graph_chains(spark, sf_dir):
    chains = G.whole_graph(_methods(spark, sf_dir))[2]
    names = F.array_join(F.transform("callers", lambda c: c["name"]), "|")
    return chains.select("id", F.size("callers").cast("long").alias("callers"), names.alias("names"))


@query(f"WITH {METHODS_CTE} SELECT file, string_agg(name, '|' ORDER BY ord) AS names, count(*) AS n FROM m GROUP BY file")
def methods_per_file(spark, sf_dir):
    own = G.per_file(_methods(spark, sf_dir), "methods", ["ord"])
    return own.select("file", F.array_join(F.transform("methods", lambda m: m["name"]), "|").alias("names"), F.size("methods").cast("long").alias("n"))


# decisions of three scans: the findings by document, with the labels as feedback
SCANS_CTE = TRIAGE_CTE + ", " + FEEDBACK_CTE + """,
    decisions AS (SELECT 'scan-' || doc_id % 3 AS scan_id, ord::VARCHAR AS issue_id, rule_id, ai_action, doc_id FROM decided),
    verdicts AS (SELECT d.scan_id, d.issue_id, f.verdict FROM decisions d JOIN feedback f USING (doc_id))"""
RIGHT = "((ai_action = 'keep' AND verdict = 'confirmed') OR (ai_action = 'drop' AND verdict = 'false_positive'))"


def _decisions(spark, sf_dir):
    base = stored_findings(spark, sf_dir, "doc_id", "ord", "rule_id", "file", "code_snippet", "ai_confidence")
    found = N.decided(N.prefilter(base))
    rows = found.select(F.concat(F.lit("scan-"), F.col("doc_id") % 3).alias("scan_id"), F.col("ord").cast("string").alias("issue_id"), "rule_id", "ai_action", "doc_id")
    given = rows.join(feedback(spark, sf_dir), "doc_id").select("scan_id", "issue_id", "verdict", F.lit("t").alias("timestamp"))
    return rows, given


@query(f"WITH {SCANS_CTE} SELECT row_number() OVER (ORDER BY scan_id DESC)::INT AS rank, scan_id FROM (SELECT DISTINCT scan_id FROM decisions)")
def scan_list(spark, sf_dir):
    """Ids of scans, the latest first; the list is as long as there were scans."""
    rows, _ = _decisions(spark, sf_dir)
    listed = H.scans(rows).agg(F.sort_array(F.collect_list("scan_id"), asc=False).alias("l"))
    return listed.select(F.posexplode("l").alias("rank", "scan_id")).withColumn("rank", F.col("rank") + 1)


@query(f"WITH {SCANS_CTE} SELECT 0 AS every, issue_id FROM decisions WHERE issue_id NOT IN (SELECT issue_id FROM verdicts) UNION ALL SELECT 1, issue_id FROM decisions")
def pending_or_all(spark, sf_dir):
    rows, given = _decisions(spark, sf_dir)
    of = lambda every: H.pending(rows, given, every).select(F.lit(int(every)).alias("every"), "issue_id")
    return of(False).unionByName(of(True))


@query(f"""WITH {SCANS_CTE}, o AS (SELECT (SELECT count(*) FROM decisions) AS total_decisions, (SELECT count(*) FROM verdicts) AS total_feedbacks, count(*) AS n, count(*) FILTER ({RIGHT}) AS c FROM decisions JOIN verdicts USING (scan_id, issue_id)),
    m AS (SELECT *, round(CASE WHEN n > 0 THEN c / n::DOUBLE ELSE 0 END, 6) AS a FROM o), p AS (SELECT *, round(a * 1000)::INT AS m FROM m),
    r AS (SELECT rule_id, count(*) AS n, count(*) FILTER ({RIGHT}) AS c, round(count(*) FILTER ({RIGHT}) / count(*)::DOUBLE, 6) AS a FROM decisions JOIN verdicts USING (scan_id, issue_id) GROUP BY 1),
    k AS (SELECT *, round(a * 1000)::INT AS m, row_number() OVER (ORDER BY a, rule_id) AS rank FROM r)
    SELECT 0 AS section, 0::BIGINT AS rank, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS txt FROM (SELECT [repeat('=', 60), 'AI 评审质量统计报告', repeat('=', 60), '', '总体统计:', '  总决策数: ' || total_decisions, '  总反馈数: ' || total_feedbacks, '  有反馈的决策: ' || n, '  正确判断: ' || c, '  错误判断: ' || (n - c), '  准确率: ' || (m // 10) || '.' || (m % 10) || '%', ''] AS l FROM p)
    UNION ALL SELECT 1, 0, 0, '按规则统计:' WHERE (SELECT count(*) FROM r) > 0
    UNION ALL SELECT 1, rank, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT rank, ['  ' || rule_id || ':', '    准确率: ' || (m // 10) || '.' || (m % 10) || '% (' || c || '/' || n || ')'] AS l FROM k)""")
def quality_report(spark, sf_dir):
    rows, given = _decisions(spark, sf_dir)
    lines = H.quality_lines(H.overall(rows, given), H.by_rule(rows, given))
    return lines.select("section", "rank", F.col("n").cast("long").alias("n"), "txt")


@query(f"""WITH {SCANS_CTE} SELECT rule_id, count(*) AS total, count(*) FILTER ({RIGHT}) AS correct, round(count(*) FILTER ({RIGHT}) / count(*)::DOUBLE, 6) AS accuracy FROM decisions JOIN verdicts USING (scan_id, issue_id) GROUP BY 1""")
def stats_cache(spark, sf_dir):
    """The cache's JSON, read back."""
    rows, given = _decisions(spark, sf_dir)
    cache = H.stats_cache(H.overall(rows, given), H.by_rule(rows, given), "now")
    read = cache.select(F.explode(F.from_json("value", "by_rule map<string,struct<total:long,correct:long,incorrect:long,accuracy:double>>")["by_rule"]).alias("rule_id", "s"))
    return read.select("rule_id", "s.total", "s.correct", "s.accuracy")


@query("SELECT count(*) AS total_files, count(*) FILTER (doc_id % 5 > 1) AS cached_files, count(*) FILTER (doc_id % 5 <= 1) AS outdated_files FROM documents")
def cache_counters(spark, sf_dir):
    return rulebase.status_counts(cache_status(spark, sf_dir))


@query(f"""WITH {TRIAGE_CTE}, s AS (SELECT count(*) AS total, count(*) FILTER ({LEVEL} = 'critical') AS critical, count(*) FILTER ({LEVEL} = 'high') AS high, count(*) FILTER ({LEVEL} = 'medium') AS medium, count(*) FILTER ({LEVEL} = 'low') AS low FROM decided),
    c AS (SELECT 'by_category' AS part, category AS name, count(*) AS n, min(ord) AS o FROM decided GROUP BY category UNION ALL SELECT 'by_action', ai_action, count(*), min(ord) FROM decided GROUP BY ai_action UNION ALL SELECT 'by_file', file, count(*), min(ord) FROM decided GROUP BY file UNION ALL SELECT 'by_rule', rule_id, count(*), min(ord) FROM decided GROUP BY rule_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, o)::INT AS rank FROM c)
    SELECT part, rank, name, n FROM r WHERE rank <= 20 OR part IN ('by_category', 'by_action') UNION ALL SELECT 'levels', 1, 'critical', critical FROM s UNION ALL SELECT 'levels', 2, 'high', high FROM s UNION ALL SELECT 'levels', 3, 'medium', medium FROM s UNION ALL SELECT 'levels', 4, 'low', low FROM s UNION ALL SELECT 'levels', 5, 'total', total FROM s""")
def report_summary(spark, sf_dir):
    """summary.json, read back: the parts as lists in their order."""
    base = stored_findings(spark, sf_dir, "rule_id", "file", "severity", "category", "code_snippet", "ai_confidence", "ord")
    counts = R.summary(N.decided(N.prefilter(base)))
    parts = "by_category map<string,long>, by_file map<string,long>, by_rule map<string,long>, by_action map<string,long>"
    read = R.summary_json(counts).select(F.from_json("value", f"critical long, high long, medium long, low long, total long, {parts}").alias("s"))
    each = lambda p: read.select(F.lit(p).alias("part"), F.posexplode(F.map_entries(f"s.{p}")).alias("rank", "e")).select("part", (F.col("rank") + 1).alias("rank"), F.col("e.key").alias("name"), F.col("e.value").alias("n"))
    out = read.select(F.lit("levels").alias("part"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"s.{c}").alias("n")) for c in ("critical", "high", "medium", "low", "total")])).alias("rank", "e"))
    out = out.select("part", (F.col("rank") + 1).alias("rank"), "e.name", "e.n")
    for p in ("by_category", "by_file", "by_rule", "by_action"):
        out = out.unionByName(each(p))
    return out


SHOWN = [
    (1, "sqli-java-concat", "security", "ERROR", "src/UserDAO.java", 42, "SQL", "use parameters", ["handle", "query"], "keep", "  a\n  b ", {"cwe": "CWE-89", "owasp": "A03"}),
    (2, "xss-js", "security", "WARNING", "web/app.js", 88, "XSS", "", [], "drop", "", {}), (3, "custom-x", "custom", "INFO", "b.py", 7, "note", None, None, None, None, {"cwe": "CWE-1"}),
]
#: The lines of the whole report on these findings, written out.
SHOWN_LINES = """# 代码评审报告

**生成时间**: T
**扫描耗时**: 1.5s

## 扫描信息

| 项目 | 值 |
|------|-----|
| 仓库 | `repo` |
| 基线分支 | `N/A` |
| 目标分支 | `N/A` |
| 规约 Profile | `default` |

## 变更统计

- 变更文件数: **3**
- 新增行数: **0**
- 删除行数: **0**

## 调用图分析

- 调用图节点: **2**
- 调用边: **1**
- 受影响方法: **2**

## 问题摘要

| 严重等级 | 数量 |
|----------|------|
| CRITICAL | 1 |
| HIGH | 1 |
| MEDIUM | 0 |
| LOW | 1 |
| **总计** | **3** |

### 按类别分布

| 类别 | 数量 |
|------|------|
| security | 2 |
| custom | 1 |

## 详细问题列表

### 1. 🔴 [sqli-java-concat] ✅ 保留

- **文件**: `src/UserDAO.java`
- **行号**: 42
- **严重等级**: ERROR
- **类别**: security
- **AI 决策**: ✅ 保留
- **描述**: SQL
- **代码片段**:
  ```
  a
  b
  ```
- **修复建议**: use parameters
- **调用链**: handle → query
- **安全标准**: CWE-89 A03

### 2. 🟡 [xss-js] 🚫 已丢弃（误报）

- **文件**: `web/app.js`
- **行号**: 88
- **严重等级**: WARNING
- **类别**: security
- **AI 决策**: 🚫 已丢弃（误报） (灰色背景)
- **描述**: XSS

### 3. 🔵 [custom-x] 🤖 待 AI 评审

- **文件**: `b.py`
- **行号**: 7
- **严重等级**: INFO
- **类别**: custom
- **AI 决策**: 🤖 待 AI 评审
- **描述**: note
- **安全标准**: CWE-1

---
*报告由代码评审工具自动生成 | NOW*""".split("\n")
SHOWN_SCHEMA = "rank long, rule_id string, category string, severity string, file string, line int, message string, fix string, call_chain array<string>, ai_action string, code_snippet string, metadata map<string,string>"
SCAN_INFO, DIFF_INFO, GRAPH_INFO = {"timestamp": "T", "duration_seconds": 1.5, "repo": "repo", "profile": "default"}, {"files_changed": 3}, {"node_count": 2, "edge_count": 1, "affected": 2}


def _shown(spark):
    shown = spark.createDataFrame(SHOWN, SHOWN_SCHEMA)
    return shown, R.summary(shown, "rank")


@query("SELECT (number - 1)::INT AS number, txt FROM " + values([(n, t) for n, t in enumerate(SHOWN_LINES, 1)], "number, txt"))
def report_markdown(spark, sf_dir):
    """The whole Markdown report: header, tables, findings with all their parts, footer."""
    shown, counts = _shown(spark)
    lines = R.report_lines(shown, counts, SCAN_INFO, DIFF_INFO, GRAPH_INFO, "NOW")
    return N.numbered_by(lines, F.col("section"), F.col("rank"), F.col("n")).select(F.col("number").cast("int").alias("number"), "txt")


@query("SELECT * FROM " + values([(r, c, s, f, ln, a) for _, r, c, s, f, ln, _, _, _, a, _, _ in SHOWN], "rule_id, category, severity, file, line, ai_action") + ", (SELECT 3 AS total, 2 AS security, 2 AS affected, 'repo' AS repo)")
def report_document(spark, sf_dir):
    """report.json as one document, put together from its lines and read back."""
    shown, counts = _shown(spark)
    lines = R.report_json_lines(shown, counts, SCAN_INFO, DIFF_INFO, GRAPH_INFO, spark.createDataFrame([("a",), ("b",)], "affected string"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "rank", "n", "txt"))), lambda x: x["txt"]), "\n").alias("json"))  # three findings
    issue = "struct<rule_id:string,category:string,severity:string,file:string,line:int,ai_action:string>"
    schema = f"scan_info struct<repo:string>, summary struct<total:int,by_category:map<string,int>>, call_graph_summary struct<affected_methods:array<string>>, issues array<{issue}>"
    read = text.select(F.from_json("json", schema).alias("r"))
    return read.select(F.explode("r.issues").alias("i"), "r").select("i.*", "r.summary.total", F.col("r.summary.by_category")["security"].alias("security"), F.size("r.call_graph_summary.affected_methods").alias("affected"), "r.scan_info.repo")


TASK_FILES = [(f"f{i}.py", i) for i in range(14)]


@query("SELECT n, path FROM (SELECT row_number() OVER (ORDER BY ord) - 1 AS n, path FROM " + values(TASK_FILES, "path, ord") + ") WHERE n < 10")
def task_changed_files(spark, sf_dir):
    """The review task's list of changed files, read back: the first ten."""
    shown, _ = _shown(spark)
    lines = R.task_lines(shown, spark.createDataFrame(TASK_FILES, "path string, ord int"), "contract", {"temperature": 0.1}, "prompt")
    paths = lines.where("section = 2 and txt like '[%'").select(F.posexplode(F.from_json("txt", "array<string>")).alias("n", "path"))
    return paths.select(F.col("n").cast("long").alias("n"), "path")


@query("SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false)) AS t(case_id, ok)")
def rule_test_totals(spark, sf_dir):
    cases = spark.createDataFrame(RULE_CASES, "case_id int, expected array<string>, is_violation boolean").withColumns({"source_file": F.lit("f"), "title": F.lit("t"), "language": F.lit("java")})
    report = R.rule_test_report(A.test_verdicts(cases, spark.createDataFrame(RULE_HITS, "case_id int, rule_id string")))
    return report.select("total", "passed", "failed")

