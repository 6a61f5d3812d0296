"""Queries on sources and rule matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators import match, rulebase
from lumensift.operators.syntax import SUPPLEMENTS, supplement_findings
from lumensift.plans.data import FINDINGS_CTE, LINES_CTE, PACK, PACK_SQL, PATCH_1, PATCH_2, PATCHES, RULE_FILES, category_sql, findings, table, values
from lumensift.plans.registry import query
from lumensift.sources import diff, rules_md
from lumensift.sources.files import multiline_matches, newlines


def _pack(spark):
    rows = [(r.rule_id, r.severity, list(r.languages), r.fix, r.message, i, int(r.regex != ""), 0) for i, r in enumerate(PACK)]
    return spark.createDataFrame(rows, "rule_id string, severity string, languages array<string>, fix string, rule_message string, rule_ord int, n_regex int, n_pattern int")


@query(f"WITH {FINDINGS_CTE} SELECT rule_id, severity, file, line, n_matches FROM findings")
def rule_scan_lines(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", "severity", "file", "line", "n_matches")


@query(r"""WITH m AS (SELECT doc_id, string_split_regex(text, '\.\n+[A-Z]') AS gaps, regexp_extract_all(text, '\.\n+[A-Z]') AS own FROM documents),
    e AS (SELECT doc_id, gaps, own, unnest(own) AS matched, generate_subscripts(own, 1)::INT AS k FROM m)
    SELECT doc_id, k, (1 + coalesce(list_sum(list_transform(gaps[1:k], lambda x: len(x) - len(replace(x, chr(10), '')))), 0)
      + coalesce(list_sum(list_transform(own[1:k - 1], lambda x: len(x) - len(replace(x, chr(10), '')))), 0))::INT AS line, matched FROM e""")
def rule_scan_multiline(spark, sf_dir):
    return multiline_matches(table(spark, sf_dir, "documents"), "doc_id", r"\.\n+[A-Z]")


@query("SELECT page_id, (1 + len(p) - len(replace(p, chr(10), '')))::INT AS line FROM (SELECT page_id, left(html, strpos(html, '<script') - 1) AS p FROM pages WHERE contains(html, '<script'))")
def match_line_number(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.col("html").contains("<script"))
    return pages.select("page_id", (1 + newlines(F.substring_index("html", "<script", 1))).cast("int").alias("line"))


@query(f"SELECT p.rule_id, d.lang, count(*) AS n_files FROM documents d JOIN {PACK_SQL} p ON len(p.languages) = 0 OR list_contains(p.languages, d.lang) GROUP BY ALL")
def rule_file_theta_join(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return match.rules_for_files(files, _pack(spark)).groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n_files"))


LANGUAGE_CASES = [(".java", ["java"]), (".py", ["python"]), (".js", ["java"]), (".jsx", ["javascript"]), (".tsx", ["typescript", "java"]), (".go", []), (".md", []), (".md", ["java"]), (".ts", ["python"]), ("", ["python"])]


@query("SELECT ext, array_to_string(languages, '|') AS languages, len(languages) = 0 OR list_contains(languages, CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EXTENSION_LANGUAGES.items()) + " ELSE '' END) AS matches FROM " + values(LANGUAGE_CASES, "ext, languages"))
def lang_match(spark, sf_dir):
    cases = spark.createDataFrame(LANGUAGE_CASES, "ext string, languages array<string>")
    return cases.select("ext", F.array_join("languages", "|").alias("languages"), T.language_matches(T.language_of(F.col("ext")), F.col("languages")).alias("matches"))


@query(f"SELECT CASE WHEN len(languages) > 1 THEN rule_id || '__' || language ELSE rule_id END AS rule_id, language FROM (SELECT rule_id, languages, unnest(CASE WHEN len(languages) = 0 THEN [NULL] ELSE languages END) AS language FROM {PACK_SQL})")
def rule_language_explode(spark, sf_dir):
    return match.language_rules(_pack(spark))


CHECK_IDS = [("tmp.x1.rules.sqli-java-concat__java",), ("xss-js-innerhtml",), ("a.b.path-read-traversal__typescript",), ("priv-python-eval__python",), ("",)]


@query("SELECT check_id, regexp_replace(string_split(check_id, '.')[-1], '__[a-z]+$', '') AS rule_id FROM " + values(CHECK_IDS, "check_id"))
def rule_id_normalize(spark, sf_dir):
    return spark.createDataFrame(CHECK_IDS, "check_id string").select("check_id", T.normal_rule_id(F.col("check_id")).alias("rule_id"))


CATEGORY_IDS = [(f"{p}-demo",) for p, _ in T.CATEGORY_PREFIXES] + [("deser-java",), ("crypto-weak",), ("log-injection-java",), ("hardcoded-password",), ("",)]


@query(f"SELECT rule_id, {category_sql('rule_id')} AS category FROM " + values(CATEGORY_IDS, "rule_id"))
def category_infer(spark, sf_dir):
    return spark.createDataFrame(CATEGORY_IDS, "rule_id string").select("rule_id", T.category(F.col("rule_id")).alias("category"))


@query(r"""WITH f AS (SELECT * FROM """ + values(RULE_FILES, "path, content") + r"""),
    s AS (SELECT path, unnest(string_split(CASE WHEN contains(content, chr(10) || '---' || chr(10)) THEN content ELSE regexp_replace(content, '(?m)^# ', chr(10) || '---' || chr(10) || '# ', 'g') END, chr(10) || '---' || chr(10))) AS section FROM f),
    h AS (SELECT path, section, regexp_extract(section, '(?s)```yaml\n(.*?)\n```', 1) AS head FROM s)
    SELECT path, trim(regexp_extract(head, '(?m)^id: *(.+)$', 1)) AS rule_id, trim(regexp_extract(section, '(?m)^# (.+)$', 1)) AS title,
      CASE WHEN regexp_extract(section, '(?m)^> (.+)$', 1) <> '' THEN trim(regexp_extract(section, '(?m)^> (.+)$', 1)) ELSE trim(regexp_extract(section, '(?m)^# (.+)$', 1)) END AS message,
      trim(regexp_extract(head, '(?m)^severity: *(.+)$', 1)) AS severity, array_to_string(string_split_regex(regexp_extract(head, '(?m)^languages: *\[(.*)\]$', 1), ', *'), '|') AS languages,
      len(regexp_extract_all(section, '(?m)^```pattern\s*$'))::INT AS n_pattern, len(regexp_extract_all(section, '(?m)^```pattern-not\s*$'))::INT AS n_not, len(regexp_extract_all(section, '(?m)^```pattern-regex\s*$'))::INT AS n_regex
    FROM h WHERE trim(regexp_extract(head, '(?m)^id: *(.+)$', 1)) <> ''""")
def rule_md_parse(spark, sf_dir):
    return rules_md.rule_rows(spark.createDataFrame(RULE_FILES, "path string, content string"))


SPECS = [("strict", "security/*.md", True, "ERROR"), ("strict", "implementation/*.md", True, "WARNING"), ("default", "security/sqli.md", True, None), ("default", "implementation/err.md", False, None), ("default", "security/missing.md", True, None)]
LOADED = [("security/sqli.md", "sqli-demo", "ERROR", True), ("security/sqli.md", "naming-demo", "INFO", False), ("implementation/err.md", "err-demo", "WARNING", True), ("security/note.txt", "no-rule", "INFO", True)]


@query(r"SELECT s.profile, r.path, r.rule_id, coalesce(s.severity_override, r.severity) AS severity FROM " + values(SPECS, "profile, g, enabled, severity_override", "s") + " JOIN " + values(LOADED, "path, rule_id, severity, enabled", "r") + r" ON regexp_full_match(r.path, replace(replace(s.g, '.', '\.'), '*', '[^/]*')) WHERE s.enabled AND r.enabled AND ends_with(r.path, '.md')")
def profile_rule_load(spark, sf_dir):
    specs = spark.createDataFrame(SPECS, "profile string, glob string, enabled boolean, severity_override string")
    return rulebase.profile_specs(specs, spark.createDataFrame(LOADED, "path string, rule_id string, severity string, enabled boolean"))


MAIL = PACK[1].regex


@query(f"WITH {LINES_CTE}, m AS (SELECT doc_id, line, unnest(regexp_extract_all(txt, '{MAIL}')) AS matched FROM lines) SELECT * FROM m WHERE NOT regexp_matches(matched, 'mail[0-4]\\.example')")
def pattern_not(spark, sf_dir):
    hits = match.scan_lines(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), [PACK[1]], "body")
    # the snippet's first line is the matched one
    each = hits.select("doc_id", "line", F.explode(F.regexp_extract_all(F.split("code_snippet", "\n")[0], F.lit(MAIL), F.lit(0))).alias("matched"))
    return match.not_excluded(each, [r"mail[0-4]\.example"])


@query(f"WITH {FINDINGS_CTE} SELECT rule_id, file, line, end_line, code_snippet FROM findings")
def snippet_window(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", "file", "line", "end_line", "code_snippet")


@query(f"WITH {FINDINGS_CTE} SELECT f.doc_id, line, rule_id, left(regexp_replace(array_to_string(string_split(d.text, chr(10))[greatest(line - 1, 1):line + 2], chr(10)), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), 300) AS restored FROM findings f JOIN documents d USING (doc_id) WHERE rule_id = 'sig-secret-assign'")
def snippet_restore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = findings(spark, sf_dir).where("rule_id = 'sig-secret-assign'").select("doc_id", "line", "rule_id")
    return match.restore_snippets(found, docs.select("doc_id", "text"), "doc_id")


REPORT = '{"results": [{"check_id": "tmp.r.sqli-java-concat__java", "path": "src/A.java", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR", "lines": "q(a + b)"}}, {"check_id": "xss-demo", "path": "/abs/b.js", "start": {"line": 9}, "end": {"line": 9}, "extra": {"message": "n", "severity": "WARNING", "lines": "requires login"}}]}'


@query("""WITH r AS (SELECT unnest(from_json(report, '{"results": [{"check_id": "VARCHAR", "path": "VARCHAR", "start": {"line": "INTEGER"}, "end": {"line": "INTEGER"}, "extra": {"message": "VARCHAR", "severity": "VARCHAR", "lines": "VARCHAR"}}]}').results) AS r FROM """ + values([(REPORT,)], "report") + """),
    a AS (SELECT regexp_replace(string_split(r.check_id, '.')[-1], '__[a-z]+$', '') AS rule_id, CASE WHEN starts_with(r.path, '/') THEN r.path ELSE '/repo/' || r.path END AS file, r.start.line AS line, r."end".line AS end_line, r.extra.severity AS severity, r.extra.lines AS code_snippet FROM r)
    SELECT * FROM a UNION ALL SELECT 'event-' || event_type, '/repo/events', json_extract(props, '$.k')::INT, NULL, 'INFO', NULL FROM events WHERE event_type = 'error'""")
def engine_json_flatten(spark, sf_dir):
    found = match.flatten_engine(spark.createDataFrame([(REPORT,)], "report string"))
    found = found.select("rule_id", T.absolute_path("/repo", F.col("file")).alias("file"), "line", "end_line", "severity", "code_snippet")
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    k = F.from_json("props", "k int")["k"]
    return found.unionByName(events.select(F.concat(F.lit("event-"), "event_type").alias("rule_id"), F.lit("/repo/events").alias("file"), k.alias("line"), F.lit("INFO").alias("severity")), allowMissingColumns=True)


PATHS = [("src/A.java",), ("node_modules/x/index.js",), ("lib/b.PY",), ("README.md",), ("a/target/B.java",), ("x/vendor.go",), ("pom.xml",), ("deep/dist/",), (".git/config.py",), ("c.hpp",), ("third-party/z.rb",), ("env/q.ts",)]


def _kept_sql(extensions: list[str], skipped: list[str]) -> str:
    inside = "[" + ", ".join(f"'{s}'" for s in skipped) + "]"
    return f"(lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) IN ({', '.join(repr(e) for e in extensions)}) AND NOT list_has_any(string_split(path, '/')[:-2], {inside}))"


@query(f"SELECT path, {_kept_sql(T.SOURCE_EXTENSIONS, T.SOURCE_SKIPPED)} AS source, {_kept_sql(T.ENGINE_EXTENSIONS, T.ENGINE_SKIPPED)} AS engine, {_kept_sql(T.GRAPH_EXTENSIONS['typescript'], T.GRAPH_SKIPPED)} AS graph FROM (SELECT path FROM " + values(PATHS, "path") + " UNION ALL SELECT regexp_replace(url, '^https?://', '') || '.js' FROM pages)")
def file_filter(spark, sf_dir):
    paths = spark.createDataFrame(PATHS, "path string")
    paths = paths.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".js")).alias("path")))
    kept = lambda e, s: T.kept_file(F.col("path"), e, s)
    return paths.select("path", kept(T.SOURCE_EXTENSIONS, T.SOURCE_SKIPPED).alias("source"), kept(T.ENGINE_EXTENSIONS, T.ENGINE_SKIPPED).alias("engine"), kept(T.GRAPH_EXTENSIONS["typescript"], T.GRAPH_SKIPPED).alias("graph"))


COMPILED = [("security/a.md",), ("compiled/b.md",), ("test-cases/c.md",), ("prompts/d.md",), ("RULE-GENERATOR-GUIDE.md",), ("design/e.yaml",), ("x/RULE-GENERATOR-GUIDE.md",)]


@query("SELECT path, ends_with(path, '.md') AND NOT (contains(path, 'compiled') OR contains(path, 'test-cases') OR contains(path, 'prompts') OR string_split(path, '/')[-1] = 'RULE-GENERATOR-GUIDE.md') AS compiled FROM " + values(COMPILED, "path"))
def compile_file_filter(spark, sf_dir):
    return spark.createDataFrame(COMPILED, "path string").select("path", T.compiled_file(F.col("path")).alias("compiled"))


SUPPLEMENT_LINES = [(1, "java", "if (apiVersion >= 3) {"), (2, "java", 'read("../etc/x"); password = "hunter22"'), (3, "xml", "<q>select ${id}</q>"), (4, "java", "${id}"), (5, "py", "secret = 'abc'"), (6, "py", "open('%2e%2e/x')")]


@query("SELECT l.id, s.rule_id, s.severity, s.cwe FROM " + values(SUPPLEMENT_LINES, "id, lang, txt", "l") + " JOIN " + values([(r.rule_id, r.severity, dict(r.metadata)["cwe"], r.regexes[0], r.languages[0] if r.languages else None) for r in SUPPLEMENTS], "rule_id, severity, cwe, regex, lang", "s") + " ON (s.lang IS NULL OR s.lang = l.lang) AND regexp_matches(l.txt, s.regex)")
def regex_supplements(spark, sf_dir):
    texts = spark.createDataFrame([(str(i), lang, txt) for i, lang, txt in SUPPLEMENT_LINES], "path string, lang string, text string")
    return supplement_findings(texts).select(F.col("file").cast("int").alias("id"), "rule_id", "severity", "cwe")


#: Patterns, code, and whether they match, worked out by hand.
TEXT_PATTERNS = [
    (r"$X.execute($Q + ...)", "stmt.execute(q  + a + b)", True), (r"$X.execute($Q + ...)", "stmt.query(q)", False), ("try {\n  ...\n} catch", "try {  \n\n a();\n } catch (E e)", True),
    ("eval(...)", "x = eval(y)", True), ("eval(...)", "evil(y)", False), ("a.b", "axb", False), ("if ($X == null)", "if (  value == null)", False), ("if ($X == null)", "if\t(value  ==  null)", True), ("f($A, $B)", "f(a, b)", True), ("f($A, $B)", "f(a,b)", False),
]


@query("SELECT pattern, code, matches FROM " + values(TEXT_PATTERNS, "pattern, code, matches"))
def pattern_translate(spark, sf_dir):
    rows = spark.createDataFrame([(p, c) for p, c, _ in TEXT_PATTERNS], "pattern string, code string")
    each = F.coalesce(*[F.when(F.col("pattern") == p, F.col("code").rlike(T.pattern_regex(p))) for p in dict.fromkeys(p for p, _, _ in TEXT_PATTERNS)])
    return rows.select("pattern", "code", each.alias("matches"))


def _patches(spark):
    return spark.createDataFrame(PATCHES, "path string, patch string, new_file boolean, deleted_file boolean, renamed_file boolean")


PATCHES_SQL = values(PATCHES, "path, patch, new_file, deleted_file, renamed_file")


@query(r"""WITH s AS (SELECT path, CASE WHEN new_file THEN 'added' WHEN deleted_file THEN 'deleted' WHEN renamed_file THEN 'renamed' ELSE 'modified' END AS status,
      (len(regexp_extract_all(patch, '\n\+')) - len(regexp_extract_all(patch, '\n\+\+\+')))::INT AS additions, (len(regexp_extract_all(patch, '\n-')) - len(regexp_extract_all(patch, '\n---')))::INT AS deletions FROM """ + PATCHES_SQL + """)
    SELECT path, status, additions::BIGINT AS additions, deletions::BIGINT AS deletions FROM s UNION ALL SELECT 'total', count(*)::VARCHAR, sum(additions)::BIGINT, sum(deletions)::BIGINT FROM s""")
def diff_stats(spark, sf_dir):
    each = diff.file_stats(_patches(spark)).select("path", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))
    total = each.agg(F.lit("total").alias("path"), F.count(F.lit(1)).cast("string").alias("status"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return each.unionByName(total)


@query(r"""WITH l AS (SELECT path, unnest(ls) AS txt, generate_subscripts(ls, 1) AS n FROM (SELECT path, string_split(patch, chr(10)) AS ls FROM """ + PATCHES_SQL + r""")),
    h AS (SELECT *, sum(CASE WHEN starts_with(txt, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS hunk FROM l),
    c AS (SELECT *, coalesce(max(CASE WHEN starts_with(txt, '@@') THEN regexp_extract(txt, '\+(\d+)', 1)::INT END) OVER (PARTITION BY path, hunk), 0)
        + sum(CASE WHEN starts_with(txt, '@@') OR (starts_with(txt, '-') AND NOT starts_with(txt, '---')) THEN 0 ELSE 1 END) OVER (PARTITION BY path, hunk ORDER BY n) - 1 AS line FROM h)
    SELECT DISTINCT path, line::INT AS line FROM c WHERE starts_with(txt, '+') AND NOT starts_with(txt, '+++')""")
def diff_changed_lines(spark, sf_dir):
    return diff.changed_lines(_patches(spark))


DIFFS = [("d1", PATCH_1 + PATCH_2), ("d2", "@@ -1 +1 @@\n+no file yet\n")]


@query(r"""WITH l AS (SELECT diff_id, unnest(ls) AS txt, generate_subscripts(ls, 1) AS n FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM """ + values(DIFFS, "diff_id, diff") + r""")),
    f AS (SELECT *, last_value(CASE WHEN starts_with(txt, '+++ b/') THEN substr(txt, 7) END IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY n) AS file FROM l),
    h AS (SELECT diff_id, file, regexp_extract(txt, '\+(\d+)', 1)::INT AS line FROM f WHERE starts_with(txt, '@@') AND file IS NOT NULL AND regexp_matches(txt, '\+\d+'))
    SELECT diff_id, file, 'line_' || line AS name, line, (line + 10)::INT AS end_line FROM h""")
def diff_hunk_methods(spark, sf_dir):
    return diff.hunk_methods(spark.createDataFrame(DIFFS, "diff_id string, diff string"))
