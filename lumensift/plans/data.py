"""Inputs of the queries: the data rule pack, inline fixtures, and base relations in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators.match import LineRule, scan_lines
from lumensift.operators.tables import settled

PACK = [
    LineRule("sig-secret-assign", "ERROR", r'(?i)(password|secret|api_key|token)\s*=\s*"[^"]+"', "secret in text", ("en",), "use a vault"),
    LineRule("auth-email-pii", "WARNING", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+", "mail address", ()),
    LineRule("priv-ip-literal", "WARNING", r"\b\d{1,3}(\.\d{1,3}){3}\b", "address literal", ("de", "fr")),
    LineRule("null-java-phone", "WARNING", r"\+?\d{1,3}[- (]\d{3}", "phone number", ("es",), "mask it"),
    LineRule("custom-license-line", "INFO", r"(?i)license|copyright|permission is hereby", "license text", ()),
    LineRule("naming-loud-token", "INFO", r"(###|%%%|\*\*\*|\$\$\$)", "loud token", ("en", "de")),
    LineRule("crypto-address-copy", "CRITICAL", r"\b\d{1,3}(\.\d{1,3}){3}\b", "copy of a rule", ("en",)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x) -> str:
    """DuckDB's literal of a value."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]" + ("::VARCHAR[]" if not x else "")
    return str(x)


def values(rows: list[tuple], columns: str, name: str = "t") -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS {name}({columns})"


def category_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({column}, '{p}') THEN '{c}'" for p, c in T.CATEGORY_PREFIXES) + " ELSE 'unknown' END"


PACK_SQL = "(SELECT * FROM " + values([(r.rule_id, r.severity, r.regex, r.message, list(r.languages), r.fix) for r in PACK], "rule_id, severity, regex, message, languages, fix") + ")"

#: lines, then findings: one row per line and rule, in the order (doc_id, line, rule_id).
LINES_CTE = "lines AS (SELECT doc_id, lang, unnest(ls) AS txt, generate_subscripts(ls, 1)::INT AS line, len(ls)::INT AS n_lines, ls FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))"
FINDINGS_CTE = LINES_CTE + f""",
    findings AS (SELECT doc_id, lang, p.rule_id, p.severity, {category_sql('p.rule_id')} AS category, 'documents/' || doc_id AS file, line, n_lines,
        least(line + 4, n_lines)::INT AS end_line, p.message, len(regexp_extract_all(txt, p.regex))::INT AS n_matches,
        array_to_string(ls[line:line + 4], chr(10)) AS code_snippet,
        CASE WHEN (doc_id + line) % 7 = 0 THEN NULL ELSE ((doc_id * 37 + line) % 101) / 100.0::DOUBLE END AS ai_confidence,
        doc_id * 100000000 + line * 100 + CASE p.rule_id {' '.join(f"WHEN '{r.rule_id}' THEN {i}" for i, r in enumerate(PACK))} END AS ord
      FROM lines JOIN {PACK_SQL} p ON regexp_matches(txt, p.regex))"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hits = scan_lines(docs, PACK)
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(PACK) for x in (r.rule_id, i)]), F.col("rule_id"))
    sure = F.when((F.col("doc_id") + F.col("line")) % 7 != 0, ((F.col("doc_id") * 37 + F.col("line")) % 101) / F.lit(100.0))
    return hits.withColumns({
        "category": T.category(F.col("rule_id")), "file": F.concat(F.lit("documents/"), "doc_id"), "ai_confidence": sure,
        "ord": F.col("doc_id") * 100_000_000 + F.col("line") * 100 + number,
    })


def stored_findings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """findings as a written table, for queries that use them more than once."""
    found = findings(spark, sf_dir)
    return settled(found.select(*columns) if columns else found)


TRIAGE_CTE = FINDINGS_CTE + """,
    triaged AS (SELECT *, CASE WHEN starts_with(rule_id, 'naming-') THEN 'naming-* style rule'
          WHEN starts_with(rule_id, 'null-java-') AND len(string_split(code_snippet, chr(10))) < 5 THEN 'code_snippet too short' END AS prefilter_reason FROM findings),
    decided AS (SELECT * REPLACE (CASE WHEN prefilter_reason LIKE 'naming%' THEN 0.9 ELSE ai_confidence END AS ai_confidence),
        CASE WHEN prefilter_reason LIKE 'naming%' THEN 'drop' WHEN prefilter_reason IS NOT NULL THEN 'needs_review' WHEN ai_confidence IS NULL THEN 'pending_review'
          WHEN ai_confidence < 0.3 THEN 'drop' WHEN ai_confidence < 0.7 THEN 'needs_review' ELSE 'keep' END AS ai_action FROM triaged)"""

#: A verdict for every labelled document: the feedback on its findings.
FEEDBACK_CTE = "feedback AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'confirmed' WHEN quality = 1 THEN 'false_positive' ELSE 'uncertain' END AS verdict FROM labels)"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 1, "false_positive").otherwise("uncertain")
    return table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict"))


#: Known issues: findings of labelled documents, their lines shifted by up to two.
KNOWN_CTE = "known AS (SELECT ord AS known_id, f.file, (f.line + f.doc_id % 3)::INT AS line, f.rule_id, f.lang FROM findings f JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)), found AS (SELECT * FROM findings WHERE (doc_id + line) % 5 <> 0)"


def known(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return found.join(labelled, "doc_id", "left_semi").select(F.col("ord").alias("known_id"), "file", (F.col("line") + F.col("doc_id") % 3).cast("int").alias("line"), "rule_id", "lang")


#: Calls: consecutive events of one user at most 12 hours apart, between event types and hours.
EDGES_CTE = """edges AS (SELECT DISTINCT 'e' || src AS src, 'e' || dst AS dst FROM (
        SELECT event_id AS src, lead(event_id) OVER w AS dst, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      WHERE gap <= 43200000000)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst"), (F.lead(micros).over(w) - micros).alias("gap"))
    return e.where("gap <= 43200000000").select(F.concat(F.lit("e"), "src").alias("src"), F.concat(F.lit("e"), "dst").alias("dst")).distinct()


JAVA = """public class Service {

    public void process(String in) {
        validate(in);
        transform(in);
        save(in);
    }

    private boolean validate(String in) {
        if (in == null) {
            return false;
        }
        return true;
    }
    private String transform(String in) {
        return in.trim();
    }

    private void save(String in) {
        store.put(in);
    }
}
"""
PYTHON = "import os\n\n\ndef load(path):\n    return parse(read(path))\n\n\ndef read(path):\n    return open(path).read()\n\n\ndef parse(text):\n    return text.split()\n"
SCRIPT = "function render(a) {\n  return draw(a);\n}\nconst draw = (a) => paint(a);\nlet paint = async x => x;\n"
CODE = [("src/Service.java", "java", JAVA), ("lib/load.py", "python", PYTHON), ("web/app.js", "javascript", SCRIPT)]

RULES_MD = """# Text from users in a query

> Text is put together to a query

```yaml
id: sqli-demo
languages: [java, python]
severity: ERROR
```

## Patterns

### Java

```pattern
$X.execute($Q + $Y)
```

```pattern-not
$X.execute("...")
```
---
# Names in capitals

```yaml
id: naming-demo
languages: [python]
severity: INFO
enabled: false
```

```pattern-regex
class [a-z]\\w+
```
"""
RULES_MD_2 = "# No rule here\n\ntext\n# A bare except\n\n```yaml\nid: err-demo\nlanguages: [python]\nseverity: WARNING\n```\n\n```pattern\nexcept:\n```\n"
RULE_FILES = [("security/sqli.md", RULES_MD), ("implementation/err.md", RULES_MD_2)]

PATCH_1 = "--- a/src/A.java\n+++ b/src/A.java\n@@ -1,4 +1,5 @@\n class A {\n-  int a;\n+  long a;\n+  long b;\n }\n@@ -20,3 +21,3 @@\n   x();\n-  y();\n+  z();\n"
PATCH_2 = "--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+import os\n+print(os)\n"
PATCHES = [("src/A.java", PATCH_1, False, False, False), ("new.py", PATCH_2, True, False, False), ("old.js", "--- a/old.js\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-x\n", False, True, False), ("b.ts", "", False, False, True)]
