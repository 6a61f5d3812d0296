"""Operators and sources of the findings engine on small inputs with worked results."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumensift.functions import cron
from lumensift.functions import text as T
from lumensift.operators import aggregates as A
from lumensift.operators import findings as N
from lumensift.operators import graph as G
from lumensift.operators import joins as J
from lumensift.operators import match, report
from lumensift.plans.data import CODE, RULES_MD, RULES_MD_2
from lumensift.sources import code, diff, files, rules_md
from lumensift.streaming import throttle


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_walk_reads_source_files_only(spark, tmp_path):
    for name in ("src/A.java", "node_modules/b.js", "c.py", "README.md", "x/target/D.java"):
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\n")
    got = files.read_files(spark, str(tmp_path / "repo"))
    assert rows(got, "path", "lang") == [("c.py", "python"), ("src/A.java", "java")]
    assert rows(files.changed_files(got), "path", "status") == [("c.py", "unchanged"), ("src/A.java", "unchanged")]


def test_rules_from_markdown():
    found = rules_md.parse(RULES_MD) + rules_md.parse(RULES_MD_2)
    assert [(r.id, r.severity, r.enabled, r.languages) for r in found] == [("sqli-demo", "ERROR", True, ["java", "python"]), ("naming-demo", "INFO", False, ["python"]), ("err-demo", "WARNING", True, ["python"])]
    assert found[0].message == "Text is put together to a query" and found[1].message == "Names in capitals"
    assert found[0].patterns == [("pattern", "$X.execute($Q + $Y)", "java"), ("pattern-not", '$X.execute("...")', "java")]
    assert rules_md.parse("no rule") == [] and rules_md.parse("# t\n```yaml\n: : :\n```") == []
    assert rules_md.flat_yaml("a:\n  - x\n  - y\nb: 'q'  # note\nc: [1, 2]") == {"a": ["x", "y"], "b": "q", "c": ["1", "2"]}


def test_method_definitions_and_calls(spark):
    sources = spark.createDataFrame(CODE, "path string, lang string, text string").where("lang = 'java'")
    methods = code.method_defs(sources)
    # a regular expression that starts with optional white space finds a definition where that begins
    assert {r.name for r in methods.collect()} == {"process", "validate", "transform", "save"}
    calls = {(r.caller, r.callee) for r in code.call_edges(sources, methods).collect()}
    assert {("process", "validate"), ("process", "transform"), ("process", "save")} <= calls
    assert code.method_defs(spark.createDataFrame([("a", "java", "} else if (b) {\n}")], "path string, lang string, text string")).count() == 0


def test_changed_lines_of_a_patch(spark):
    patch = "@@ -1,3 +10,4 @@\n a\n-b\n+c\n+d\n e\n@@ -9 +30 @@\n+z"
    assert rows(diff.changed_lines(spark.createDataFrame([("f", patch)], "path string, patch string"))) == [("f", 11), ("f", 12), ("f", 30)]


@pytest.mark.parametrize(
    "pattern,compat,regex",
    [("$X.run($Y)", False, r"\w+\.run\(\w+\)"), ("a b", False, r"a\s+b"), ("a b", True, r"a\\s+b"), ("f(...)", False, r"f\([\s\S]*?\)"), ("", False, None), ("x" * 1001, False, None)],
)
def test_pattern_translation(pattern, compat, regex):
    assert T.pattern_regex(pattern, compat) == regex


def test_fusion_keeps_the_better_engine_and_the_first_place(spark):
    found = spark.createDataFrame([("f", 1, "r", None, 0), ("f", 1, "r", "ast", 1), ("f", 1, "r", "builtin-v2", 2), ("f", 2, "r", "builtin-v2", 3), ("f", 2, "r", "other", 4)], "file string, line int, rule_id string, engine string, ord int")
    assert rows(N.fuse(found), "line", "engine", "ord", "first_ord") == [(1, "ast", 1, 0), (2, "builtin-v2", 3, 3)]


def test_numbering_is_one_sequence(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 10007).alias("k"))
    want = {k: n for n, k in enumerate(sorted(i * 37 % 10007 for i in range(5000)))}
    assert {r.k: r.number for r in N.numbered(df, "k", span=64).collect()} == want
    assert {r.k: r.number for r in N.numbered_by(df, F.col("k")).collect()} == want


def test_decisions_at_the_thresholds(spark):
    df = spark.createDataFrame([(c,) for c in (None, 0.0, 0.29, 0.3, 0.69, 0.7, 1.0)], "ai_confidence double").withColumns({"is_false_positive": F.lit(False), "needs_review": F.lit(False), "prefilter_reason": F.lit(None).cast("string")})
    assert [r.ai_action for r in N.decided(df).orderBy(F.col("ai_confidence").asc_nulls_first()).collect()] == ["pending_review", "drop", "drop", "needs_review", "needs_review", "keep", "keep"]


def test_prefilter_switched_off(spark):
    df = spark.createDataFrame([("naming-x", "a", "b")], "rule_id string, file string, code_snippet string")
    assert N.prefilter(df, frozenset()).first().prefilter_reason is None
    assert N.prefilter(df).first().ai_confidence == 0.9


def test_last_valid_review_wins(spark):
    found = spark.createDataFrame([("a", "keep", 0.9), ("b", "keep", 0.8)], "issue_id string, ai_action string, ai_confidence double")
    reviews = spark.createDataFrame([("a", True, False, "0.1", 1), ("a", False, True, "0.5", 2), ("a", False, False, "7", 3), ("z", True, False, "0.5", 4)], "issue_id string, is_false_positive boolean, needs_review boolean, ai_confidence string, ord int")
    assert rows(N.merge_reviews(found, reviews), "issue_id", "ai_action", "ai_confidence", "ai_reviewed") == [("a", "needs_review", 0.5, True), ("b", "keep", 0.8, False)]


def test_accuracy_of_the_worked_example(spark):
    decisions = spark.createDataFrame([("1", "keep"), ("2", "drop"), ("3", "keep")], "issue_id string, ai_action string")
    feedback = spark.createDataFrame([("1", "confirmed", 0), ("2", "confirmed", 0), ("3", "false_positive", 0)], "issue_id string, verdict string, ord int")
    assert tuple(A.accuracy(A.judged(decisions, feedback, ["issue_id"])).first()) == (3, 1, 2, 0.333333)
    assert tuple(A.accuracy(A.judged(decisions, feedback.where("false"), ["issue_id"])).first()) == (0, 0, 0, 0.0)


def test_unknown_severities_are_medium_and_security_lifts_them(spark):
    df = spark.createDataFrame([("CRITICAL", "unknown"), ("CRITICAL", "security"), ("error", "x"), (None, "x"), ("INFO", "security")], "severity string, category string")
    assert tuple(A.severity_summary(df).first()) == (5, 1, 1, 2, 1)


def test_nearest_prefers_distance_then_order(spark):
    left = spark.createDataFrame([(1, "f", 10), (2, "f", 100), (3, "g", 10)], "id int, file string, line int")
    right = spark.createDataFrame([("f", 12, 5), ("f", 8, 3), ("f", 94, 1)], "file string, line int, ord int")
    got = J.nearest(left, right, "file", "line", 5, ["id"], "ord")
    assert rows(got, "id", "near_line", "distance") == [(1, 8, 2), (2, None, None), (3, None, None)]


def test_spans_without_known_changes_all_stay(spark):
    spans = spark.createDataFrame([("f", 1, 5), ("f", 6, 9), ("g", 1, 2)], "file string, line int, end_line int")
    points = spark.createDataFrame([("f", 7)], "file string, changed_line int")
    assert rows(J.overlapping(spans, points, "file"), "file", "line") == [("f", 6), ("g", 1)]


def test_graph_reach_and_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("y", "z")], "src string, dst string")
    seeds = spark.createDataFrame([("c",)], "node string")
    assert rows(G.reached(edges, seeds)) == [("a", 2), ("b", 1), ("c", 0), ("x", 1)]
    assert G.reached(edges, seeds.where("false")).count() == 0
    assert [r.chain for r in G.chains(edges, seeds).collect()] == [["c", "b", "a"]]
    assert rows(G.induced(edges, G.reached(edges, seeds)), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")]


def test_cron(spark):
    now = dt.datetime(2024, 2, 28, 23, 30)
    df = spark.createDataFrame([("0 2 * * *", now), ("45 23 * * *", now), ("30 23 * * *", now), ("*/15 * * * *", now), ("61 * * * *", now)], "expr string, now timestamp")
    got = [(r.v, r.n) for r in df.select(cron.valid(F.col("expr")).alias("v"), cron.next_run(F.col("expr"), F.col("now")).alias("n")).collect()]
    day = dt.datetime(2024, 2, 29)
    assert got == [(True, day.replace(hour=2)), (True, now.replace(minute=45)), (True, day.replace(hour=23, minute=30)), (True, None), (False, None)]


def test_throttle_counts_from_the_last_sent_alert(spark):
    alerts = spark.createDataFrame([("k", t) for t in (0, 6, 11, 16, 21)], "key string, at long")
    assert rows(throttle.throttle(alerts, "key", "at", 10)) == [("k", 0), ("k", 11), ("k", 21)]
    assert throttle.throttle(alerts, "key", "at", 0).count() == 5


def test_throttle_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, t) for t in (0, 6, 11, 16, 21)] + [(2, 3)], "key long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at long").parquet(str(tmp_path / "in"))
    q = throttle.throttle_stream(stream, 10).writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("sent")) == [(1, 0), (1, 11), (1, 21), (2, 3)]


def test_sinks_and_review_source(spark, tmp_path):
    report.write_json(spark.createDataFrame([("s1", 1), ("s2", 2)], "scan_id string, n int"), str(tmp_path / "log"), by="scan_id")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    report.write_text(spark.createDataFrame([(2, "b"), (1, "a")], "n int, txt string"), str(tmp_path / "md"), ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] in (["a", "b"], ["b", "a"])
    one = spark.createDataFrame([("i", "confirmed")], "issue_id string, verdict string")
    for _ in range(2):
        report.append_feedback(one, str(tmp_path / "g"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text(json.dumps([{"issue_id": "1", "ai_confidence": "0.5"}]))
    (tmp_path / "r/b.json").write_text(json.dumps({"results": [{"issue_id": "2"}, {"issue_id": "3"}]}))
    (tmp_path / "r/c.json").write_text("{}")
    assert [r[0] for r in rows(report.read_reviews(spark, str(tmp_path / "r")), "issue_id")] == ["1", "2", "3"]


def test_exclusions_look_at_the_match_only(spark):
    found = spark.createDataFrame([("user@example.com",), ("me@site.org",)], "matched string")
    assert rows(match.not_excluded(found, [r"example\.com$"])) == [("me@site.org",)]


def test_absent_llm_folder_leaves_the_rest_alone(tmp_path):
    import ast
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    for path in (top / "lumensift").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not [n for n in names if n.startswith("lumensift.llm")], path
    shutil.copytree(top / "lumensift", tmp_path / "lumensift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    n, same = said.stdout.split()
    assert int(n) > 90 and same == "True"
