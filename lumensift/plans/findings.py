"""Queries on fused, triaged, reviewed and counted findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import aggregates as A
from lumensift.operators import findings as N
from lumensift.operators import report as R
from lumensift.plans.data import FEEDBACK_CTE, FINDINGS_CTE, PACK_SQL, TRIAGE_CTE, feedback, findings, stored_findings, table, values
from lumensift.plans.registry import query
from lumensift.plans.scans import _pack
from lumensift.sources import rules_md


@query(f"WITH {FINDINGS_CTE} SELECT rule_id, count(*) AS n FROM findings GROUP BY 1")
def count_by_rule(spark, sf_dir):
    return A.counted(findings(spark, sf_dir), "rule_id")


ENGINES_CTE = FINDINGS_CTE + """,
    engines AS (SELECT file, line, rule_id, severity, category, NULL AS engine, ord * 3 AS ord FROM findings
      UNION ALL SELECT file, line, rule_id, 'CRITICAL', NULL, 'builtin-v2', ord * 3 + 1 FROM findings WHERE (doc_id + line) % 2 = 0
      UNION ALL SELECT file, line, rule_id, severity, category, 'ast', ord * 3 + 2 FROM findings WHERE (doc_id + line) % 3 = 0)"""


def _engines(spark, sf_dir):
    found = stored_findings(spark, sf_dir, "doc_id", "file", "line", "rule_id", "severity", "category", "ord")
    at = lambda n: (F.col("ord") * 3 + n).alias("ord")
    text = found.select("file", "line", "rule_id", "severity", "category", at(0))
    tree = found.where((F.col("doc_id") + F.col("line")) % 2 == 0).select("file", "line", "rule_id", F.lit("CRITICAL").alias("severity"), F.lit("builtin-v2").alias("engine"), at(1))
    exact = found.where((F.col("doc_id") + F.col("line")) % 3 == 0).select("file", "line", "rule_id", "severity", "category", F.lit("ast").alias("engine"), at(2))
    return N.union_engines(text, tree, exact)


@query(f"WITH {ENGINES_CTE} SELECT file, line, rule_id, severity, category, engine, ord FROM engines")
def engine_union(spark, sf_dir):
    return _engines(spark, sf_dir)


@query(f"""WITH {ENGINES_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY CASE coalesce(engine, 'semgrep') WHEN 'ast' THEN 0 WHEN 'semgrep' THEN 1 WHEN 'regex' THEN 2 WHEN 'builtin' THEN 2 ELSE 99 END, ord) AS k, min(ord) OVER (PARTITION BY file, line, rule_id) AS first_ord FROM engines)
    SELECT file, line, rule_id, severity, engine, first_ord FROM r WHERE k = 1""")
def dedup_priority(spark, sf_dir):
    return N.fuse(_engines(spark, sf_dir)).select("file", "line", "rule_id", "severity", "engine", "first_ord")


INLINE = [(1, "sqli-mybatis-dollar", "a/pom.xml", "<v>${project.version}</v>"), (2, "sqli-mybatis-dollar", "a/M.java", "${x}"), (3, "crypto-hardcoded-key-java", "src/AppConstants.java", "k"), (4, "crypto-hardcoded-key-java", "src/App.java", "k"), (5, "naming-java-x", "a", "b"), (6, "xss-js-innerhtml", "a.js", "1\n2\n3\n4\n5"), (7, "xss-js-innerhtml", "a.js", "1\n2"), (8, "null-java-x", "b", None), (9, "err-x", "c", "d")]
PREFILTER = """CASE WHEN rule_id = 'sqli-mybatis-dollar' AND ends_with(file, '.xml') AND contains(coalesce(code_snippet, ''), '${') AND contains(coalesce(code_snippet, ''), '}') THEN 'sqli-mybatis-dollar in pom.xml'
      WHEN rule_id = 'crypto-hardcoded-key-java' AND contains(lower(file), 'constants') THEN 'crypto-hardcoded-key in Constants class'
      WHEN starts_with(rule_id, 'naming-') THEN 'naming-* style rule'
      WHEN (starts_with(rule_id, 'null-java-') OR starts_with(rule_id, 'path-traversal-') OR starts_with(rule_id, 'xss-') OR starts_with(rule_id, 'sqli-')) AND len(string_split(coalesce(code_snippet, ''), chr(10))) < 5 THEN 'code_snippet too short' END"""


@query(f"""WITH {FINDINGS_CTE}, every AS (SELECT ord, rule_id, file, code_snippet FROM findings UNION ALL SELECT -id, rule_id, file, code_snippet FROM {values(INLINE, 'id, rule_id, file, code_snippet')}),
    p AS (SELECT ord, rule_id, {PREFILTER} AS prefilter_reason FROM every)
    SELECT ord, rule_id, prefilter_reason, coalesce(prefilter_reason <> 'code_snippet too short', false) AS is_false_positive, coalesce(prefilter_reason = 'code_snippet too short', false) AS needs_review,
      CASE WHEN prefilter_reason LIKE 'sqli%' THEN 0.99 WHEN prefilter_reason LIKE 'crypto%' THEN 0.95 WHEN prefilter_reason LIKE 'naming%' THEN 0.9 END::DOUBLE AS ai_confidence, prefilter_reason IS NULL AS to_review FROM p""")
def prefilter_triage(spark, sf_dir):
    inline = spark.createDataFrame([(-i, *rest) for i, *rest in INLINE], "ord long, rule_id string, file string, code_snippet string")
    every = findings(spark, sf_dir).select("ord", "rule_id", "file", "code_snippet").unionByName(inline)
    out = N.prefilter(every)
    return out.select("ord", "rule_id", "prefilter_reason", "is_false_positive", "needs_review", "ai_confidence", F.col("prefilter_reason").isNull().alias("to_review"))


def _decided(spark, sf_dir):
    return N.decided(N.prefilter(findings(spark, sf_dir)))


@query(f"WITH {TRIAGE_CTE} SELECT ord, rule_id, ai_action, ai_confidence::DOUBLE AS ai_confidence FROM decided")
def decision_case(spark, sf_dir):
    return _decided(spark, sf_dir).select("ord", "rule_id", "ai_action", "ai_confidence")


@query(f"WITH {TRIAGE_CTE} SELECT ai_action, count(*) AS n FROM decided WHERE ai_action IS DISTINCT FROM 'drop' GROUP BY 1")
def undropped_actions(spark, sf_dir):
    return A.counted(N.undropped(_decided(spark, sf_dir)), "ai_action")


@query(f"WITH {FINDINGS_CTE} SELECT ord, printf('scan-%04d', row_number() OVER (ORDER BY ord) - 1) AS issue_id, concat_ws(':', file, line, rule_id) AS fallback_id FROM findings")
def issue_id_assign(spark, sf_dir):
    each = N.numbered(findings(spark, sf_dir), "doc_id", "ord")
    return each.select("ord", T.issue_id("scan", F.col("number")).alias("issue_id"), T.fallback_issue_id(F.col("file"), F.col("line"), F.col("rule_id")).alias("fallback_id"))


THRESHOLDS = [0.3, 0.5, 0.7, 0.9]


@query(f"WITH {FINDINGS_CTE} SELECT t.threshold::DOUBLE AS threshold, rule_id, count(*) AS n FROM findings JOIN {values([(t,) for t in THRESHOLDS], 'threshold')} ON ai_confidence >= t.threshold WHERE line % 2 = 0 GROUP BY ALL")
def confidence_threshold(spark, sf_dir):
    kept = N.with_confidence_at_least(findings(spark, sf_dir).withColumn("is_valid", F.col("line") % 2 == 0), THRESHOLDS)
    return kept.groupBy("threshold", "rule_id").agg(F.count(F.lit(1)).alias("n"))


REVIEWS = [("a", "0.5"), ("", "0.5"), ("  ", "0.1"), (None, "0.2"), ("b", "1.5"), ("c", "-0.1"), ("d", "high"), ("e", None), ("f", "1"), ("g", "0"), ("h", "1e-1")]


@query("SELECT issue_id, ai_confidence, trim(coalesce(issue_id, '')) <> '' AND (ai_confidence IS NULL OR coalesce(try_cast(ai_confidence AS DOUBLE) BETWEEN 0 AND 1, false)) AS valid FROM " + values(REVIEWS, "issue_id, ai_confidence"))
def review_validate(spark, sf_dir):
    return N.valid_reviews(spark.createDataFrame(REVIEWS, "issue_id string, ai_confidence string"))


REVIEWS_CTE = TRIAGE_CTE + """,
    reviews AS (SELECT ord::VARCHAR AS issue_id, line % 3 = 0 AS is_false_positive, line % 3 = 1 AS needs_review, CASE WHEN line % 11 = 0 THEN 'bad' ELSE (line % 10 / 10.0)::DECIMAL(3,1)::VARCHAR END AS ai_confidence, 1 AS ord FROM findings WHERE doc_id % 2 = 0
      UNION ALL SELECT ord::VARCHAR, false, line % 2 = 0, '0.8', 2 FROM findings WHERE doc_id % 4 = 0),
    last AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY ord DESC) AS k FROM reviews WHERE try_cast(ai_confidence AS DOUBLE) BETWEEN 0 AND 1)"""


@query(f"""WITH {REVIEWS_CTE} SELECT d.ord::VARCHAR AS issue_id, CASE WHEN r.issue_id IS NULL THEN d.ai_action WHEN r.is_false_positive THEN 'drop' WHEN r.needs_review THEN 'needs_review' ELSE 'keep' END AS ai_action,
      (CASE WHEN r.issue_id IS NULL THEN d.ai_confidence ELSE r.ai_confidence::DOUBLE END)::DOUBLE AS ai_confidence, r.issue_id IS NOT NULL AS ai_reviewed FROM decided d LEFT JOIN last r ON r.issue_id = d.ord::VARCHAR AND r.k = 1""")
def review_merge(spark, sf_dir):
    base = stored_findings(spark, sf_dir, "doc_id", "file", "line", "rule_id", "code_snippet", "ai_confidence", "ord").withColumn("issue_id", F.col("ord").cast("string"))
    found = N.decided(N.prefilter(base))
    line = F.col("line")
    sure = F.when(line % 11 == 0, "bad").otherwise((line % 10 / 10).cast("decimal(3,1)").cast("string"))
    one = base.where("doc_id % 2 = 0").select("issue_id", (line % 3 == 0).alias("is_false_positive"), (line % 3 == 1).alias("needs_review"), sure.alias("ai_confidence"), F.lit(1).alias("ord"))
    two = base.where("doc_id % 4 = 0").select("issue_id", F.lit(False).alias("is_false_positive"), (line % 2 == 0).alias("needs_review"), F.lit("0.8").alias("ai_confidence"), F.lit(2).alias("ord"))
    return N.merge_reviews(found, one.unionByName(two)).select("issue_id", "ai_action", "ai_confidence", "ai_reviewed")


@query(f"WITH {FINDINGS_CTE} SELECT ord, f.rule_id, p.fix, p.message AS rule_message FROM findings f LEFT JOIN {PACK_SQL} p USING (rule_id)")
def finding_rule_enrich(spark, sf_dir):
    return N.enrich(findings(spark, sf_dir), _pack(spark), ["fix", "rule_message"]).select("ord", "rule_id", "fix", "rule_message")


@query(f"""WITH {TRIAGE_CTE}, u AS (SELECT ord, 'reviewed' AS ai_action FROM findings WHERE line % 5 = 0) SELECT d.ord, coalesce(u.ai_action, d.ai_action) AS ai_action FROM decided d LEFT JOIN u USING (ord)""")
def decision_upsert(spark, sf_dir):
    base = stored_findings(spark, sf_dir, "ord", "line", "rule_id", "file", "code_snippet", "ai_confidence")
    rows = N.decided(N.prefilter(base)).select("ord", "ai_action")
    updates = base.where("line % 5 = 0").select("ord", F.lit("reviewed").alias("ai_action"))
    return N.upsert(rows, updates, "ord", ["ai_action"])


LEVEL = "CASE WHEN severity = 'ERROR' THEN 'critical' WHEN severity = 'INFO' THEN 'low' WHEN category = 'security' THEN 'high' ELSE 'medium' END"


@query(f"WITH {FINDINGS_CTE}, l AS (SELECT {LEVEL} AS level FROM findings) SELECT count(*) AS total, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low FROM l")
def summary_severity(spark, sf_dir):
    return A.severity_summary(findings(spark, sf_dir))


@query(f"WITH {FINDINGS_CTE} SELECT category, count(*) AS n FROM findings GROUP BY 1")
def summary_by_category(spark, sf_dir):
    return A.counted(findings(spark, sf_dir), "category")


@query(f"WITH {TRIAGE_CTE} SELECT ai_action, count(*) AS n FROM decided GROUP BY 1")
def summary_by_action(spark, sf_dir):
    return A.counted(_decided(spark, sf_dir), "ai_action", "pending_review")


@query(f"WITH {FINDINGS_CTE}, c AS (SELECT file, count(*) AS n, min(ord) AS o FROM findings GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, o)::INT AS rank, file, n FROM c ORDER BY rank LIMIT 20")
def topk_files(spark, sf_dir):
    return A.top(findings(spark, sf_dir), "file", "ord")


@query(f"WITH {FINDINGS_CTE}, c AS (SELECT rule_id, count(*) AS n, min(ord) AS o FROM findings GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, o)::INT AS rank, rule_id, n FROM c ORDER BY rank LIMIT 20")
def topk_rules(spark, sf_dir):
    return A.top(findings(spark, sf_dir), "rule_id", "ord")


@query("SELECT row_number() OVER (ORDER BY ts DESC, event_id)::INT AS rank, event_id, event_type FROM events ORDER BY rank LIMIT 10")
def recent_feedback_topk(spark, sf_dir):
    last = table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(10)
    return last.select(F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).alias("rank"), "event_id", "event_type")


@query(f"WITH {FINDINGS_CTE} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'INFO' THEN 2 ELSE 1 END, file, ord) AS rank, ord, severity FROM findings")
def severity_sort(spark, sf_dir):
    return R.ranked(findings(spark, sf_dir)).select("rank", "ord", "severity")


@query(f"WITH {FINDINGS_CTE}, {FEEDBACK_CTE} SELECT ord, rule_id FROM findings WHERE doc_id NOT IN (SELECT doc_id FROM feedback)")
def pending_feedback(spark, sf_dir):
    return findings(spark, sf_dir).join(feedback(spark, sf_dir), "doc_id", "left_anti").select("ord", "rule_id")


@query(f"WITH {FINDINGS_CTE} SELECT doc_id FROM findings EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query(f"WITH {FINDINGS_CTE} SELECT doc_id FROM findings INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query(f"WITH {FINDINGS_CTE} SELECT DISTINCT rule_id, severity FROM findings")
def distinct_rules(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", "severity").distinct()


def _judged(spark, sf_dir):
    verdicts = feedback(spark, sf_dir).withColumn("ord", F.lit(0))
    return A.judged(_decided(spark, sf_dir).drop("ord"), verdicts, ["doc_id"])


CORRECT = "((ai_action = 'keep' AND verdict = 'confirmed') OR (ai_action = 'drop' AND verdict = 'false_positive'))"
ACCURACY = f"count(*) AS total_with_feedback, count(*) FILTER ({CORRECT}) AS correct, count(*) FILTER (NOT {CORRECT}) AS incorrect, round(CASE WHEN count(*) > 0 THEN count(*) FILTER ({CORRECT}) / count(*)::DOUBLE ELSE 0 END, 6) AS accuracy"


@query(f"WITH {TRIAGE_CTE}, {FEEDBACK_CTE} SELECT {ACCURACY} FROM decided JOIN feedback USING (doc_id)")
def decision_accuracy(spark, sf_dir):
    return A.accuracy(_judged(spark, sf_dir))


@query(f"WITH {TRIAGE_CTE}, {FEEDBACK_CTE} SELECT rule_id, {ACCURACY} FROM decided JOIN feedback USING (doc_id) GROUP BY rule_id")
def accuracy_by_rule(spark, sf_dir):
    return A.accuracy(_judged(spark, sf_dir), "rule_id")


@query(f"WITH {FEEDBACK_CTE} SELECT count(*) AS total, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict = 'uncertain') AS uncertain FROM feedback")
def feedback_summary(spark, sf_dir):
    return A.feedback_summary(feedback(spark, sf_dir))


RULE_CASES = [(1, ["a", "b"], True), (2, ["a"], True), (3, [], False), (4, [], False), (5, ["c"], True)]
RULE_HITS = [(1, "b"), (1, "a"), (1, "z"), (2, "b"), (4, "a")]


@query(f"""WITH h AS (SELECT case_id, array_to_string(list_sort(list(DISTINCT rule_id)), '|') AS actual, list(rule_id) AS l FROM {values(RULE_HITS, 'case_id, rule_id')} GROUP BY 1)
    SELECT c.case_id, coalesce(h.actual, '') AS actual, CASE WHEN c.is_violation THEN list_has_all(coalesce(h.l, []), c.expected) ELSE h.case_id IS NULL END AS passed FROM {values(RULE_CASES, 'case_id, expected, is_violation', 'c')} LEFT JOIN h USING (case_id)""")
def rule_test_verdict(spark, sf_dir):
    cases = spark.createDataFrame(RULE_CASES, "case_id int, expected array<string>, is_violation boolean")
    out = A.test_verdicts(cases, spark.createDataFrame(RULE_HITS, "case_id int, rule_id string"))
    return out.select("case_id", F.array_join("actual", "|").alias("actual"), "passed")


SAMPLES = [("## 1. 违规代码\n```java\nint a;\n```\n**预期命中**: `x-1`, `x-2`",), ("## ok\n```py\nb\n```\n**预期命中**: 无",), ("## A Violation\n```js\nc\n```\n```js\nd\n```",), ("## no code",)]


@query(r"""SELECT regexp_extract(s, '(?m)^## (.+)$', 1) AS title, regexp_extract(s, '(?s)```(\w+)\n(.*?)```', 1) AS language, trim(regexp_extract(s, '(?s)```(\w+)\n(.*?)```', 2), chr(10) || ' ') AS code,
      array_to_string(CASE WHEN regexp_extract(s, '\*\*预期命中\*\*:\s*(.+)', 1) = '无' THEN [] ELSE regexp_extract_all(regexp_extract(s, '\*\*预期命中\*\*:\s*(.+)', 1), '`([^`]+)`', 1) END, '|') AS expected,
      contains(s, '违规代码') OR contains(regexp_extract(s, '(?m)^## (.+)$', 1), '违规') OR contains(lower(s), 'violation') AS is_violation FROM """ + values(SAMPLES, "s") + r""" WHERE regexp_matches(s, '(?s)```(\w+)\n(.*?)```')""")
def test_case_parse(spark, sf_dir):
    found = rules_md.test_cases(spark.createDataFrame([("cases/a.md", s) for (s,) in SAMPLES], "path string, content string"))
    return found.select("title", "language", "code", F.array_join("expected", "|").alias("expected"), "is_violation")


@query("WITH f AS (SELECT 'documents/' || doc_id AS path, sha256(text) AS hash, doc_id FROM documents) SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'not_compiled' WHEN doc_id % 5 = 1 THEN 'outdated' ELSE 'cached' END AS status, left(hash, 8) AS hash, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'deadbeef' ELSE left(hash, 8) END AS cached_hash FROM f")
def cache_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("documents/"), "doc_id").alias("path"), F.col("text").alias("content"))
    manifest = files.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, F.lit("deadbeef00")).otherwise(F.sha2("content", 256)).alias("hash"))
    return A.cache_status(files, manifest)


PARAMS = [("security", "temperature", "0.1", "0.3", None), ("security", "max_tokens", "2048", None, "512"), ("quality", "temperature", "0.2", None, None), ("comprehensive", "max_tokens", "1024", "900", "800"), ("architecture", "top_p", None, "0.9", None)]


@query("SELECT workflow, param, coalesce(cli, yaml, standard) AS value FROM " + values(PARAMS, "workflow, param, standard, yaml, cli") + " WHERE coalesce(cli, yaml, standard) IS NOT NULL")
def param_overlay(spark, sf_dir):
    rows = spark.createDataFrame(PARAMS, "workflow string, param string, standard string, yaml string, cli string")
    return A.overlaid(rows, "workflow", "param", ["standard", "yaml", "cli"])


PROMPTS = [("a", 'x = """\nfirst\n"""\ny = """second"""'), ("b", "whole file"), ("c", "")]


@query("SELECT name, CASE WHEN regexp_matches(content, '(?s)\"\"\"(.*?)\"\"\"') THEN regexp_replace(regexp_extract(content, '(?s)\"\"\"(.*?)\"\"\"', 1), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') WHEN content <> '' THEN content ELSE 'default' END AS prompt FROM " + values(PROMPTS, "name, content"))
def prompt_extract(spark, sf_dir):
    return spark.createDataFrame(PROMPTS, "name string, content string").select("name", rules_md.prompt(F.col("content")).alias("prompt"))
