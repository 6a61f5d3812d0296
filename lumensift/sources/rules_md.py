"""Rules written in Markdown: a loader for the driver, and the same as expressions over a table of files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions import text as T

# Headings that name a language.
HEADINGS = {"java": "java", "python": "python", "node.js": "javascript", "nodejs": "javascript", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "go": "go"}

_FENCE = re.compile(r"^```(\w[\w-]*)[ \t]*\n(.*?)(?:^```|\Z)", re.MULTILINE | re.DOTALL)
_HEADING = re.compile(r"^(##|###)\s+(.+)$", re.MULTILINE)


@dataclass
class Rule:
    id: str | None = None
    title: str | None = None
    message: str | None = None
    severity: str | None = None
    category: str | None = None
    languages: list[str] = field(default_factory=list)
    enabled: bool = True
    fix: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    patterns: list[tuple[str, str, str | None]] = field(default_factory=list)  # kind, content, language


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return {"true": True, "false": False}.get(text.lower(), text)


def flat_yaml(text: str) -> dict:
    """Keys with scalars, flow lists or indented lists: what rule headers consist of. Other lines are ignored."""
    out, key = {}, None
    for line in text.splitlines():
        if m := re.match(r"^([\w-]+):\s*(.*)$", line):
            key = m[1]
            out[key] = _scalar(re.sub(r"\s+#.*$", "", m[2])) if m[2].strip() else []
        elif key and (m := re.match(r"^\s*-\s+(.*)$", line)) and isinstance(out[key], list):
            out[key].append(_scalar(m[1]))
    return out


def sections(content: str) -> list[str]:
    """Parts between ``---`` lines, or else from one first-level heading to the next."""
    if "\n---\n" in content:
        return [s.strip() for s in content.split("\n---\n") if s.strip()]
    return [s for s in re.split(r"(?m)(?=^# )", content) if s]


def parse_section(section: str) -> Rule:
    rule = Rule()
    fences = list(_FENCE.finditer(section))
    inside = lambda at: any(f.start() <= at < f.end() for f in fences)
    if m := re.search(r"^# (.+)$", section, re.MULTILINE):
        rule.title = m[1].strip()
    m = re.search(r"^> (.+)$", section, re.MULTILINE)
    rule.message = m[1].strip() if m else rule.title
    marks = [(h.start(), HEADINGS.get(h[2].strip().lower()) if h[1] == "###" else None) for h in _HEADING.finditer(section) if not inside(h.start())]
    for f in fences:
        kind, body = f[1].lower(), f[2].strip()
        if kind == "yaml":
            head = flat_yaml(body)
            rule.id, rule.severity = head.get("id", rule.id), head.get("severity", rule.severity)
            rule.category, rule.fix = head.get("category", rule.category), head.get("fix", rule.fix)
            found = head.get("languages", rule.languages)
            rule.languages = found if isinstance(found, list) else [found]
            rule.enabled = head.get("enabled", rule.enabled)
            rule.metadata = {k: str(v) for k, v in head.items() if k not in ("id", "languages", "severity", "category", "fix")}
        elif kind in ("pattern", "pattern-not", "pattern-regex"):
            language = next((lang for at, lang in reversed(marks) if at < f.start()), None)
            rule.patterns.append((kind, body, language))
    return rule


def parse(content: str) -> list[Rule]:
    """The rules of a file: sections that name an id."""
    return [r for r in map(parse_section, sections(content)) if r.id]


def rule_rows(files: DataFrame) -> DataFrame:
    """(path, rule_id, title, message, severity, languages, n_pattern, n_not, n_regex) of files (path, content), without Python."""
    by_line = F.split("content", "\n---\n", -1)
    by_head = F.split("content", r"(?m)(?=^# )", -1)
    each = files.select("path", F.explode(F.when(F.col("content").contains("\n---\n"), by_line).otherwise(by_head)).alias("section"))
    head = F.regexp_extract("section", r"(?s)```yaml\n(.*?)\n```", 1)
    value = lambda key: F.trim(F.regexp_extract(head, rf"(?m)^{key}: *(.+)$", 1))
    title = F.trim(F.regexp_extract("section", r"(?m)^# (.+)$", 1))
    quote = F.trim(F.regexp_extract("section", r"(?m)^> (.+)$", 1))
    listed = F.regexp_extract(value("languages"), r"^\[(.*)\]$", 1)
    count = lambda kind: F.regexp_count("section", F.lit(rf"(?m)^```{kind}\s*$")).cast("int")
    out = each.select(
        "path", value("id").alias("rule_id"), title.alias("title"), F.when(quote != "", quote).otherwise(title).alias("message"), value("severity").alias("severity"),
        F.array_join(F.split(listed, ", *"), "|").alias("languages"), count("pattern").alias("n_pattern"), count("pattern-not").alias("n_not"), count("pattern-regex").alias("n_regex"),
    )
    return out.where("rule_id <> ''")


def test_cases(files: DataFrame) -> DataFrame:
    """(source_file, case_id, title, language, code, expected, is_violation) of files (path, content) of test cases.

    A section with a code block is a case; its first block is the code. It is a violation if its text or title says so.
    """
    each = files.select(F.substring_index("path", "/", -1).alias("source_file"), F.posexplode(F.split("content", "\n---\n", -1)).alias("case_id", "_raw"))
    each = each.withColumn("_s", T.stripped(F.col("_raw")))
    block, wanted = r"(?s)```(\w+)\n(.*?)```", T.stripped(F.regexp_extract("_s", r"\*\*预期命中\*\*:\s*(.+)", 1))
    title = F.regexp_extract("_s", r"(?m)^## (.+)$", 1)
    expected = F.when(wanted == "无", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(wanted, F.lit("`([^`]+)`"), F.lit(1)))
    bad = F.col("_s").contains("违规代码") | title.contains("违规") | F.lower("_s").contains("violation")
    return each.where(F.col("_s").rlike(block)).select(
        "source_file", "case_id", title.alias("title"), F.regexp_extract("_s", block, 1).alias("language"), T.stripped(F.regexp_extract("_s", block, 2)).alias("code"), expected.alias("expected"), bad.alias("is_violation"),
    )


def prompt(content: Column) -> Column:
    """The first block in triple quotes of a prompt file, else the whole of it, else the default."""
    block = r'(?s)"""(.*?)"""'
    return F.when(content.rlike(block), T.stripped(F.regexp_extract(content, block, 1))).when(content != "", content).otherwise("default")
