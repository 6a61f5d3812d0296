"""The scan from folder and rule files on, its settings, stores and caches."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lumensift.functions.needles import needles
from lumensift.operators import graph as G
from lumensift.operators import harness as H
from lumensift.operators import joins as J
from lumensift.operators import match, report, rulebase
from lumensift.operators.scan import scan, scan_folder
from lumensift.plans.data import RULES_MD, RULES_MD_2
from lumensift.plans.whole import SCAN_RULES, SCANNED, TREE_CODE
from lumensift.sources import config, files, java, rules_md

PROFILE = """# a profile
name: default
specs:
  # all of them
  - path: security/*.md
    enabled: true
    severity_override: WARNING
  - path: implementation/err.md
  - path: implementation/missing.md
    enabled: true
  - path: "custom/regex.md"
    enabled: false
exclude:
  - "**/test/**"
"""


@pytest.fixture
def rules(tmp_path):
    folder = tmp_path / "rules"
    for name, text in [*SCAN_RULES, ("security/note.txt", "no rule"), ("compiled/old.md", RULES_MD), ("prompts/p.md", RULES_MD), ("RULE-GENERATOR-GUIDE.md", RULES_MD), ("profiles/default.yaml", PROFILE)]:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return folder


@pytest.fixture
def code(tmp_path):
    folder = tmp_path / "code"
    for name, text in [*[(p, t) for p, _, t in SCANNED], ("src/Gate.java", TREE_CODE), ("conf/map.xml", "<q>${id}</q>"), ("vendor/x.java", TREE_CODE), ("notes.txt", "x")]:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return folder


def test_block_yaml():
    text = """a: 1          # a number
b:
  - x
  - {}
  - c: 'quoted: # text'
    d: [1, 2.5, "three"]
e:
- same indent
f: a long text
  that goes on
g: |
  line 1

   line 2
h: null
i: true
"""
    want = {"a": 1, "b": ["x", {}, {"c": "quoted: # text", "d": [1, 2.5, "three"]}], "e": ["same indent"], "f": "a long text that goes on", "g": "line 1\n\n line 2\n", "h": None, "i": True}
    assert config.load_yaml(text) == want and config.load_yaml("") is None
    value = {"rules": [{"id": "x", "languages": ["a"], "message": "m: n", "patterns": [{"pattern": "$X.f(...)\n}"}, {"pattern-not": "a # b"}], "n": 3, "none": [], "t": "true"}], "nested": [["p", "q"], [[1]]]}
    assert config.load_yaml(config.dump_yaml(value)) == value


def test_settings_and_what_stands_for_them(rules, tmp_path):
    assert config.load_config(str(tmp_path / "none.yaml")) == {}
    assert config.load_harness(str(tmp_path / "none.yaml"))["harness"]["decision_logging"]["keep_recent"] == 10
    assert config.load_profile(str(rules), "default") == config.load_profile(str(rules), "no such profile")
    assert config.prefilter_rules({"prefilter": {"enabled": True, "rules": {"a": {"enabled": True}, "b": {"enabled": False}, "c": None}}}) == {"a", "c"}
    assert config.prefilter_rules({"prefilter": {"enabled": False, "rules": {"a": {}}}}) == config.prefilter_rules({}) == set()
    assert config.overlaid({"a": 1, "b": 2}, {"b": 3, "c": None}, None, {"a": 4}) == {"a": 4, "b": 3}


def test_rules_by_profile(rules, spark):
    profile = config.load_profile(str(rules), "default")
    loaded = rulebase.load_rules(str(rules), profile)
    assert [(r.id, r.severity) for r in loaded] == [("sqli-demo", "WARNING"), ("err-demo", "WARNING")]
    assert [r.id for r in rulebase.load_rules(str(rules))] == ["custom-last", "err-demo", "sqli-demo"]
    assert rulebase.load_rules(str(rules), profile, frozenset({"sqli-demo", "err-demo"})) == []


def test_compiled_rules(spark):
    parsed = rules_md.parse(RULES_MD) + rules_md.parse(RULES_MD_2) + rules_md.parse(SCAN_RULES[-1][1])
    own = {r.rule_id: r for r in rulebase.compiled(parsed, spark)}
    assert own["custom-last"].regexes == (r"pass\s*\n",)  # the last regular expression, and no pattern beside it
    assert own["sqli-demo"].languages == ("java", "python") and len(own["sqli-demo"].nots) == 1
    apart = rulebase.compiled(rules_md.parse(RULES_MD), spark, by_language=True)
    assert [(r.rule_id, r.languages) for r in apart if r.rule_id == "sqli-demo"] == [("sqli-demo", ("java",))]
    broken = rules_md.Rule("x", patterns=[("pattern-regex", "(", None)])
    assert rulebase.compiled([broken, rules_md.Rule("y")], spark) == []


def test_external_engine_rules():
    rule = rules_md.parse(RULES_MD)[0]
    both = rulebase.engine_rules([rule, rules_md.Rule("none")])["rules"]
    assert [(r["id"], r["languages"]) for r in both] == [("sqli-demo__java", ["java"])]  # its patterns are Java's
    assert both[0]["patterns"] == [{"pattern": "$X.execute($Q + $Y)"}, {"pattern-not": '$X.execute("...")'}]
    one = rulebase.engine_rule(rules_md.Rule("a", patterns=[("pattern", "p", None), ("pattern", "q", None)]), ["go"])
    assert one["patterns"] == [{"pattern-either": [{"pattern": "p"}, {"pattern": "q"}]}]
    assert rulebase.engine_rule(rules_md.Rule("a", patterns=[("pattern", "p", None)]), ["go"])["pattern"] == "p"
    last = rulebase.engine_rule(rules_md.Rule("a", patterns=[("pattern", "p", None), ("pattern-regex", "r", None), ("pattern-regex", "s", None)]), ["go"])
    assert last["pattern-regex"] == "s"
    assert config.load_yaml(config.dump_yaml({"rules": both})) == {"rules": both}


def test_compiled_cache(rules, spark):
    first = rulebase.compile_rules(str(rules), "t1")
    assert rulebase.compile_rules(str(rules), "t2") == first
    manifest = {r.path: (r.compiled_at, r.rules_count) for r in rulebase.manifest_rows(spark, str(rules / "compiled")).collect()}
    assert manifest == {"custom/regex.md": ("t1", 1), "implementation/err.md": ("t1", 1), "security/sqli.md": ("t1", 2)}
    (rules / "implementation/err.md").write_text(RULES_MD_2.replace("err-demo", "err-new"))
    assert "err-new" in [r.id for r in rulebase.compile_rules(str(rules), "t3")]
    assert json.loads((rules / "compiled/manifest.json").read_text())["implementation/err.md"]["compiled_at"] == "t3"
    assert {r.compiled_at for r in rulebase.manifest_rows(spark, str(rules / "compiled")).collect()} == {"t1", "t3"}
    rulebase.compile_rules(str(rules), "t4", force=True)
    assert {r.compiled_at for r in rulebase.manifest_rows(spark, str(rules / "compiled")).collect()} == {"t4"}


def test_scan_of_a_folder(rules, code, spark):
    began = time.time()
    got = scan_folder(spark, str(code), str(rules), config={"prefilter": {"enabled": True, "rules": {"short-code-snippet": {"enabled": True}}}})
    rows = got.collect()
    assert time.time() - began < 60
    assert sorted((r.rule_id, r.file, r.line) for r in rows if r.engine is None) == [
        ("err-demo", "lib/job.py", 3), ("sqli-demo", "lib/job.py", 2), ("sqli-demo", "src/Dao.java", 3), ("sqli-demo", "src/Dao.java", 6),
    ]
    assert {r.rule_id for r in rows if r.engine == "builtin-v2"} >= {"xxe-java-document-builder-usage", "sqli-mybatis-dollar", "priv-java-runtime-exec"}
    assert not [r for r in rows if r.file.startswith("vendor")]
    assert sorted(r.issue_id for r in rows) == [f"scan-{n:04d}" for n in range(len(rows))]
    assert {r.ai_action for r in rows if r.rule_id == "xxe-java-document-builder-usage"} == {"pending_review"}
    # five lines of code are long enough for a review, the four that are left at a file's end aren't
    assert {(r.file, r.line): r.ai_action for r in rows if r.rule_id == "sqli-demo"} == {("lib/job.py", 2): "pending_review", ("src/Dao.java", 3): "pending_review", ("src/Dao.java", 6): "needs_review"}
    assert files.graph_files(spark, str(code), "javascript").count() == 1 and files.graph_files(spark, str(code), "cobol").count() == 4


def test_scan_without_rules_or_files(spark):
    nothing = spark.createDataFrame(SCANNED, "path string, lang string, text string")
    assert match.scan_texts(nothing, []).count() == 0
    own = rulebase.compiled(rules_md.parse(RULES_MD), spark)
    assert scan(nothing.where("false"), own).count() == 0
    messy = spark.createDataFrame([("a.java", None, "x.execute(a + b)"), (None, "java", None), ("b.java", "java", ""), ("c.java", "java", "x.execute(a + b)" * 300)], "path string, lang string, text string")
    assert match.scan_texts(messy, own).groupBy("file").count().collect() == [("c.java", 300)]


def test_rule_corpus_by_path(spark):
    folder = os.environ.get("RULE_CORPUS")
    if not folder:
        pytest.skip("RULE_CORPUS names no folder of rules")
    loaded = rulebase.load_rules(folder, config.load_profile(folder, "default"))
    assert len(loaded) == 101
    assert len(rulebase.load_rules(folder)) >= 101
    own = rulebase.compiled(loaded, spark)
    assert {r.rule_id for r in own} <= {r.id for r in loaded} and len(own) > 80
    sources = spark.createDataFrame(SCANNED, "path string, lang string, text string")
    match.scan_texts(sources, own).collect()


def test_needles_lose_no_match(spark):
    import random
    import re

    rng = random.Random(3)
    regexes = [r"(?i)(password|secret)\s*=", r"a+b?c", r"[xy]z", r"(ab|cd)+e", r"^a", r"b$", r"\bq\w", r"(?=a)a", r"a.c", r"x{0,2}", r"k(?:l|m|)n", r"[^a]b"]
    texts = ["".join(rng.choice("abcdexyzqklmnPASSWORDpassword =\n") for _ in range(rng.randrange(60))) for _ in range(300)] + ["PassWord =", "secret="]
    rules = [match.LineRule(f"r{i}", "INFO", r) for i, r in enumerate(regexes)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.line, r.rule_id) for r in match.scan_lines(df, rules).collect()}
    want = {(i, n, f"r{k}") for i, t in enumerate(texts) for n, ln in enumerate(t.split("\n"), 1) for k, r in enumerate(regexes) if re.search(r, ln) and re.search(r, ln).group() != ""}
    empty = {(i, n, "r9") for i, t in enumerate(texts) for n, _ in enumerate(t.split("\n"), 1)}
    assert want <= got and got - want <= empty
    assert needles(r"x{0,2}").any_of == () and needles(r"ab(c|d)").any_of == ("ab",)


def test_java_nodes():
    nodes = java.java_nodes(TREE_CODE)
    named = [(n["type"], n["name"]) for n in nodes]
    assert [n for t, n in named if t == "method_declaration"] == ["load", "safe", "check"]
    assert ("class_declaration", "Gate") in named and ("method_invocation", "newDocumentBuilder") in named
    call = next(n for n in nodes if n["name"] == "getInstance")
    assert nodes[call["method"]]["name"] == "check" and nodes[call["class"]]["name"] == "Gate"
    assert not [n for n in nodes if "not this one" in TREE_CODE[n["start"] : n["stop"]] and n["type"] == "method_invocation"]
    for text in ("", "{{{", ")))", 'class A { void f( { "unended }', "/* open", "'"):
        java.java_nodes(text)


def test_syntax_nodes_of_messy_rows(spark):
    rows = spark.createDataFrame([("a.java", "java", None), (None, "java", "class A { int f() { return g(1); } }"), ("b.py", "python", "f(1)")], "path string, lang string, text string")
    assert {r.type for r in java.syntax_nodes(rows).collect()} >= {"class_declaration", "method_declaration", "method_invocation"}


def test_decision_log_and_feedback(spark, tmp_path):
    log, store, space = (str(tmp_path / n) for n in ("decisions", "feedback", "workspace"))
    found = spark.createDataFrame([("1", "sqli-java", "a.java", 1, "ERROR", "SQL", "keep", 0.85, "r", "code"), ("2", "xxe-java", "b.java", None, None, "XXE", "drop", 0.72, "r", None), ("3", "xss-js", "c.js", 3, "WARNING", "XSS", "keep", None, "r", "")],
                                  "issue_id string, rule_id string, file string, line int, severity string, message string, ai_action string, ai_confidence double, ai_reasoning string, code_snippet string")
    for scan_id in ("2024-01-01_00-00-00", "2024-01-02_00-00-00"):
        H.log_decisions(H.decision_rows(found, scan_id, "t", "repo", "security"), log)
    H.log_decisions(H.decision_rows(found.where("issue_id <> '3'"), "2024-01-02_00-00-00", "t", "repo", "security"), log)
    assert [r.scan_id for r in H.scans(H.read_decisions(spark, log)).collect()] == ["2024-01-02_00-00-00", "2024-01-01_00-00-00"]
    one = H.read_decisions(spark, log, "2024-01-01_00-00-00")
    assert one.count() == 3 and H.read_decisions(spark, log).count() == 5
    second = one.where("issue_id = '2'").first()
    assert (second.line, second.severity, second.ai_evidence, second.total_issues, second.user_verdict) == (0, "UNKNOWN", [], 3, None)
    given = [("1", "2024-01-01_00-00-00", "false_positive", None, "t0"), ("1", "2024-01-01_00-00-00", "confirmed", "c", "t1"), ("2", "2024-01-01_00-00-00", "confirmed", None, "t2")]
    for row in given:
        H.add_feedback(spark.createDataFrame([row], H.FEEDBACK), store, space, store)
    judged = H.read_feedback(spark, store)
    assert judged.count() == 3 and H.read_feedback(spark, space).count() == 3
    assert H.read_feedback(spark, store, issue_id="1").count() == 2 and H.read_feedback(spark, store, scan_id="none").count() == 0
    assert [r.issue_id for r in H.pending(one, judged).collect()] == ["3"] and H.pending(one, judged, every=True).count() == 3
    assert tuple(H.overall(one, judged).first()) == (3, 3, 2, 1, 1, 0.5)
    assert {r.rule_id: r.accuracy for r in H.by_rule(one, judged).collect()} == {"sqli-java": 1.0, "xxe-java": 0.0}
    H.add_feedback(spark.createDataFrame([("3", "x", "uncertain")], "issue_id string, scan_id string, verdict string"), store)
    H.sync_feedback(spark, store, space)
    assert H.read_feedback(spark, space).count() == 4
    assert [(r.issue_id, r.rule_id) for r in H.recent_examples(judged, one, 2).collect()] == [("2", "xxe-java"), ("1", "sqli-java")]
    cache = json.loads(H.stats_cache(H.overall(one, judged), H.by_rule(one, judged), "now").first().value)
    assert cache["generated_at"] == "now" and cache["by_rule"]["sqli-java"] == {"total": 1, "correct": 1, "incorrect": 0, "accuracy": 1.0}


def test_report_files(spark, tmp_path):
    from lumensift.plans.whole import DIFF_INFO, GRAPH_INFO, SCAN_INFO, SHOWN_LINES, _shown

    shown, counts = _shown(spark)
    order = ["section", "rank", "n"]
    report.write_text(report.report_lines(shown, counts, SCAN_INFO, DIFF_INFO, GRAPH_INFO, "NOW"), str(tmp_path / "md"), order)
    assert "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))).rstrip("\n").split("\n") == SHOWN_LINES
    report.write_text(report.report_json_lines(shown, counts, SCAN_INFO, DIFF_INFO, GRAPH_INFO), str(tmp_path / "json"), order)
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    assert [i["rule_id"] for i in whole["issues"]] == ["sqli-java-concat", "xss-js", "custom-x"] and whole["issues"][2]["fix"] is None
    assert whole["summary"] == {"total": 3, "critical": 1, "high": 1, "medium": 0, "low": 1, "by_category": {"security": 2, "custom": 1}, "by_file": {"src/UserDAO.java": 1, "web/app.js": 1, "b.py": 1}, "by_rule": {"sqli-java-concat": 1, "xss-js": 1, "custom-x": 1}, "by_action": {"keep": 1, "drop": 1, "pending_review": 1}}
    task = report.task_lines(shown, spark.createDataFrame([("a.py", 0)], "path string, ord int"), "c", {"t": 1}, "p", {"total": 3, "confirmed": 1, "false_positive": 1, "uncertain": 1}, [("r", "confirmed", "ok")] * 7)
    lines = [r.txt for r in task.orderBy(*order).collect()]
    assert lines.count("- 规则 `r`: 用户确认（真实问题）（ok）") == 5 and "- 历史准确率: 33.3%" in lines and '["a.py"]' in lines
    assert report.task_lines(shown.where("false"), spark.createDataFrame([("a.py", 0)], "path string, ord int"), "c", {}, "p").count() == 0


def test_changed_graph(spark):
    methods = spark.createDataFrame([("a", "f", 1, 0), ("a", "g", 5, 1), ("b", "f", 2, 2), ("b", "f", 2, 3), ("c", "h", 9, 4)], "file string, name string, line int, ord int")
    calls = spark.createDataFrame([("f", "g"), ("f", "g"), ("h", "x")], "caller string, callee string")
    nodes, edges, chains, touched = G.changed_graph(methods, calls, spark.createDataFrame([("a", "g", 5)], "file string, name string, line int"))
    assert {r.affected for r in touched.collect()} == {"f", "g"} and {r.id for r in nodes.collect()} == {"a:1", "a:5", "b:2"}
    assert {r.id: r.chain for r in chains.collect()} == {"a:5": ["g", "f"]}
    assert {(r["from"], r["to"]) for r in edges.collect()} == {("a:1", "a:5"), ("b:2", "a:5")}
    none = G.changed_graph(methods, calls, spark.createDataFrame([], "file string, name string, line int"))
    assert [df.count() for df in none] == [0, 0, 0, 0]


def test_overlapping_at_the_edges(spark):
    spans = spark.createDataFrame([("f", 1, 3), ("f", 1, 3), ("f", 4, 4), ("f", 5, 9), ("g", 1, 2), (None, 1, 1)], "file string, line int, end_line int")
    points = spark.createDataFrame([("f", 3), ("f", 3), ("f", 4), ("f", 10)], "file string, changed_line int")
    assert sorted((tuple(r) for r in J.overlapping(spans, points, "file").collect()), key=str) == sorted([("f", 1, 3), ("f", 1, 3), ("f", 4, 4), ("g", 1, 2), (None, 1, 1)], key=str)
    assert J.overlapping(spans, points.where("false"), "file").count() == 6


def test_known_found_across_buckets(spark):
    known = spark.createDataFrame([(i, "f", i, "r") for i in range(0, 200, 7)], "known_id int, file string, line int, rule_id string")
    found = spark.createDataFrame([("f", i, i + 4, "r") for i in range(3, 200, 40)], "file string, line int, end_line int, rule_id string")
    for how, slack, fits in (("line", 2, lambda k, f: abs(k - f) <= 2), ("range", 5, lambda k, f: f - 5 <= k <= f + 9), ("exact", 2, lambda k, f: k == f)):
        got = {r.known_id for r in J.known_found(known, found, how, slack).where("detected").collect()}
        assert got == {k for k in range(0, 200, 7) if any(fits(k, f) for f in range(3, 200, 40))}


def test_throttle_of_a_long_key(spark):
    from lumensift.streaming.throttle import throttle

    alerts = spark.range(30_000).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    assert throttle(alerts, "key", "at", 100).count() == 300


def test_git_source(spark, tmp_path):
    import shutil
    import subprocess

    from lumensift.sources import diff, git

    if not shutil.which("git"):
        pytest.skip("no git")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-b", "one")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/Main.java").write_text('public class Main {\n    public void hello() {\n        print("hello");\n    }\n}\n')
    (tmp_path / "old name.py").write_text("def a():\n    pass\n" * 5)
    (tmp_path / "gone.txt").write_text("x\n")
    run("add", ".")
    run("commit", "-m", "1")
    run("checkout", "-b", "two")
    (tmp_path / "src/Main.java").write_text('public class Main {\n    public void hello() {\n        print("hello world");\n    }\n    public void bye() {\n        print("bye");\n    }\n}\n')
    (tmp_path / "src/New.java").write_text("public class New {\n    public void test() {}\n}\n")
    (tmp_path / "gone.txt").unlink()
    run("mv", "old name.py", "new.py")
    run("add", "-A")
    run("commit", "-m", "2")
    assert git.is_repository(str(tmp_path)) and not git.is_repository(str(tmp_path / "src"))
    stats = {r.path: (r.status, r.additions, r.deletions) for r in diff.file_stats(git.git_patches(spark, str(tmp_path), "one", "two")).collect()}
    assert stats == {"src/Main.java": ("modified", 4, 1), "src/New.java": ("added", 3, 0), "gone.txt": ("deleted", 0, 1), "new.py": ("renamed", 0, 0)}
    methods = {(r.file, r.name) for r in git.changed_methods(spark, str(tmp_path), "one", "two").collect()}
    assert {("src/Main.java", "hello"), ("src/Main.java", "bye"), ("src/New.java", "test"), ("new.py", "a")} <= methods
    assert {"src/Main.java", "src/New.java"} <= {r.path for r in git.git_stat(spark, str(tmp_path), "one", "two").collect()}
    with pytest.raises(ValueError, match="diff"):
        git.git_patches(spark, str(tmp_path), "one", "no such branch")


def test_external_engine(spark, tmp_path):
    from lumensift.sources import engine

    rules = rules_md.parse(RULES_MD)
    assert engine.engine_findings(spark, str(tmp_path), rules, binary="/no/such/engine").count() == 0
    fake = tmp_path / "engine.sh"
    fake.write_text("""#!/bin/sh
test -s "$2" || exit 2
echo '{"results": [{"check_id": "tmp.sqli-demo__java", "path": "a/B.java", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR", "lines": "x"}}]}'
""")
    fake.chmod(0o755)
    got = engine.engine_findings(spark, str(tmp_path), rules, binary=str(fake)).collect()
    assert [(r.rule_id, r.file, r.line, r.category) for r in got] == [("sqli-demo", f"{tmp_path}/a/B.java", 3, "security")]
    slow = tmp_path / "slow.sh"
    slow.write_text("#!/bin/sh\nexec sleep 20\n")
    slow.chmod(0o755)
    assert engine.engine_output(str(tmp_path), rules, binary=str(slow), timeout=0.5) == engine.NOTHING
    assert engine.engine_output(str(tmp_path), [], binary=str(fake)) == engine.NOTHING


def test_notifications(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lumensift.streaming import notify

    got = []

    class Target(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if self.path == "/bad" else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Target)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert notify.post(url, "{}") and not notify.post(url + "bad", "{}") and not notify.post("", "{}") and not notify.post("http://127.0.0.1:9/", "{}", 1)
    got.clear()
    assert notify.Runner(lambda: {"total_issues": 2}, url, True).run() == {"total_issues": 2}
    assert got[0]["event"] == "scan.complete" and got[0]["data"] == {"total_issues": 2}
    got.clear()
    now = [0.0]

    def fails():
        raise RuntimeError("no")

    runner = notify.Runner(fails, url, True, throttle=10, clock=lambda: now[0])
    for at in (0, 5, 10, 15):
        now[0] = at
        with pytest.raises(RuntimeError):
            runner.run()
    assert [g["data"]["error_type"] for g in got] == ["RuntimeError", "RuntimeError"] and {g["status"] for g in got} == {"success"}
    got.clear()
    notify.post_each(url)(spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "payload string"), 0)
    assert sorted(g["a"] for g in got) == [1, 2]
    server.shutdown()


def test_schedule(spark):
    import datetime as dt

    from lumensift.streaming.schedule import Schedule

    now, ran = [dt.datetime(2024, 2, 28, 23, 30)], []

    def scan():
        ran.append(now[0])
        if len(ran) == 1:
            raise RuntimeError("first one fails")

    schedule = Schedule(spark, "0 2 * * *", scan, lambda: now[0])
    assert schedule.due == dt.datetime(2024, 2, 29, 2) and not schedule.tick()
    for at in (dt.datetime(2024, 2, 29, 2, 0, 1), dt.datetime(2024, 2, 29, 2, 0, 2), dt.datetime(2024, 3, 1, 3)):
        now[0] = at
        schedule.tick()
    assert ran == [dt.datetime(2024, 2, 29, 2, 0, 1), dt.datetime(2024, 3, 1, 3)]
    with pytest.raises(ValueError, match="schedule"):
        Schedule(spark, "61 * * * *", scan)
    now[0] = dt.datetime(2024, 3, 2, 3)
    query = schedule.start("200 milliseconds")
    query.processAllAvailable()
    deadline = time.time() + 30
    while len(ran) < 3 and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    assert len(ran) == 3


def test_decisions_are_updated_in_place(spark, tmp_path):
    log = str(tmp_path / "log")
    found = spark.createDataFrame([("1", "keep", 0.9, "a"), ("2", "keep", 0.8, "b")], "issue_id string, ai_action string, ai_confidence double, ai_reasoning string").withColumns({c: F.lit("x") for c in ("rule_id", "file", "severity", "message", "code_snippet")}).withColumn("line", F.lit(1))
    for scan_id, rows in (("s1", found), ("s2", found.where("issue_id = '2'").withColumn("issue_id", F.lit("3")))):
        H.log_decisions(H.decision_rows(rows, scan_id, "t", "r", "w"), log)
    H.update_decisions(spark, log, spark.createDataFrame([("1", "drop", None, None), ("9", "drop", 0.1, "z")], "issue_id string, ai_action string, ai_confidence double, ai_reasoning string"), "t2")
    got = {r.issue_id: (r.scan_id, r.ai_action, r.ai_confidence, r.ai_reasoning, r.updated_at) for r in H.read_decisions(spark, log).collect()}
    assert got == {"1": ("s1", "drop", 0.9, "a", "t2"), "2": ("s1", "keep", 0.8, "b", None), "3": ("s2", "keep", 0.8, "b", None)}


def test_workspace(tmp_path):
    import datetime as dt

    made = H.workspace(str(tmp_path), dt.datetime(2024, 1, 2, 3, 4, 5), "x")
    assert made["scan_id"].startswith("2024-01-02_03-04-05_") and all(os.path.isdir(made[k]) for k in ("report", "cache", "decisions"))


def test_cases_of_several_sections(spark):
    text = "## 1. 违规代码\n```java\nint a;\n```\n```java\nint b;\n```\n**预期命中**: `x-1`, `x-2`\n---\n## ok\n```py\nb\n```\n**预期命中**: 无\n---\nno code\n---\n"
    got = rules_md.test_cases(spark.createDataFrame([("t/cases.md", text)], "path string, content string")).orderBy("case_id").collect()
    assert [(r.source_file, r.case_id, r.code, r.expected, r.is_violation) for r in got] == [("cases.md", 0, "int a;", ["x-1", "x-2"], True), ("cases.md", 1, "b", [], False)]


def test_full_scan(spark):
    from lumensift.sources import code as C

    given, methods = C.full_scan(spark.createDataFrame(SCANNED, "path string, lang string, text string"))
    assert {r.status for r in given.collect()} == {"unchanged"} and given.count() == 3
    assert {(r.file, r.name) for r in methods.collect()} >= {("src/Dao.java", "a")}


def test_rules_of_ones_own(spark):
    from lumensift.operators.syntax import checked

    def long_methods(path, text, nodes):
        return [{"rule_id": "own-long", "severity": "INFO", "line": text.count("\n", 0, n["start"]) + 1, "message": n["name"]} for n in nodes if n["type"] == "method_declaration" and n["stop"] - n["start"] > 300]

    sources = spark.createDataFrame([("G.java", "java", TREE_CODE), ("x.py", "python", "def f(): pass"), ("n.java", "java", None)], "path string, lang string, text string")
    got = checked(sources, long_methods).collect()
    assert [(r.file, r.rule_id, r.message, r.engine, r.cwe) for r in got] == [("G.java", "own-long", "check", "builtin-v2", None)]
    assert checked(sources, lambda path, text, nodes: [{"rule_id": "r"}], []).count() == 3


def test_review_workflows(spark, tmp_path):
    from lumensift.operators.review import DEFAULT_PROMPT, Review, workflow_names

    assert workflow_names() == ["security", "quality", "performance", "architecture", "comprehensive"]
    (tmp_path / "code-quality-prompt.md").write_text('intro\n"""\nfirst\n"""\n"""second"""')
    (tmp_path / "security-audit-prompt.md").write_text("whole file")
    (tmp_path / "p.yaml").write_text("temperature: 0.5\nmodel: own\n")
    review = Review("quality", str(tmp_path), str(tmp_path / "p.yaml"), temperature=0.7, top_p=None)
    assert review.params == {"temperature": 0.7, "max_tokens": 2048, "top_p": 0.9, "model": "own"} and review.prompt == "first"
    assert review.switch("security") and review.prompt == "whole file" and not review.switch("none") and review.workflow == "security"
    assert review.switch("architecture") and review.prompt == DEFAULT_PROMPT
    assert Review("no such", params_file=str(tmp_path / "none.yaml")).params["max_tokens"] == 1024
    found = spark.createDataFrame([(1, "r")], "rank int, rule_id string")
    lines = [r.txt for r in review.task(found, spark.createDataFrame([("a", 1)], "path string, ord int"), "contract").orderBy("section", "rank", "n").collect()]
    assert lines[0] == "contract" and '  "temperature": 0.7,' in lines
