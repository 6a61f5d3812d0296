"""Scalar expressions over rule ids, file names, severities and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule id prefixes in the order in which they are tried, and their categories.
CATEGORY_PREFIXES = [
    ("xxe", "security"), ("xss", "security"), ("auth", "security"), ("path", "security"),
    ("priv", "security"), ("sig", "security"), ("sqli", "security"), ("ssrf", "security"),
    ("arch", "design"), ("api", "design"), ("db", "design"),
    ("naming", "implementation"), ("err", "implementation"), ("conc", "implementation"), ("null", "implementation"),
    ("custom", "custom"),
]

# Languages of file extensions.
EXTENSION_LANGUAGES = {".java": "java", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}

# What a full walk and an engine walk keep, and the folders that each leaves out.
SOURCE_EXTENSIONS = [".java", ".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala", ".rb", ".php"]
SOURCE_SKIPPED = [".git", "node_modules", "__pycache__", "target", "build", "dist", ".python", "venv", ".venv", "env", ".env", "site-packages", ".python-version", "vendor", "third_party", "third-party"]
# What call graphs read, by language, and the folders that they leave out.
GRAPH_EXTENSIONS = {"java": [".java"], "python": [".py"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx", ".js", ".jsx"]}
GRAPH_OTHERWISE = [".java", ".py", ".js", ".ts"]
GRAPH_SKIPPED = [".git", "node_modules", "target", "build", "__pycache__", ".venv", "vendor"]
ENGINE_LANGUAGES = {".java": "java", ".py": "python", ".js": "javascript", ".ts": "typescript", ".xml": "xml", ".md": "markdown"}
ENGINE_EXTENSIONS = [".java", ".py", ".js", ".ts", ".xml", ".jsx", ".tsx"]
ENGINE_SKIPPED = [".git", "node_modules", "target", "build", "__pycache__", ".venv", "vendor", "dist", ".idea", ".settings"]

# Words that look like method names in front of a parenthesis.
RESERVED = ["if", "for", "while", "switch", "catch", "try"]


def category(rule_id: Column) -> Column:
    """The category of the first prefix that fits, or unknown."""
    out = F.lit("unknown")
    for prefix, name in reversed(CATEGORY_PREFIXES):
        out = F.when(rule_id.startswith(prefix), name).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """The last suffix of the file name with its point, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def language_of(ext: Column, languages: dict[str, str] = EXTENSION_LANGUAGES) -> Column:
    pairs = [F.lit(x) for pair in languages.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit(""))


def language_matches(language: Column, languages: Column) -> Column:
    """An empty list fits every language."""
    return (F.size(languages) == 0) | F.array_contains(languages, language)


def kept_file(path: Column, extensions: list[str], skipped: list[str]) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return extension(path).isin(extensions) & ~F.arrays_overlap(folders, F.array(*map(F.lit, skipped)))


def compiled_file(path: Column) -> Column:
    """Whether the rule compiler reads the file."""
    apart = ["compiled", "test-cases", "prompts"]
    name = F.substring_index(path, "/", -1)
    skipped = F.lit(False)
    for word in apart:
        skipped = skipped | path.contains(word)
    return path.endswith(".md") & ~(skipped | (name == "RULE-GENERATOR-GUIDE.md"))


def normal_rule_id(check_id: Column) -> Column:
    """The part behind the last point, without a language suffix."""
    return F.regexp_replace(F.substring_index(check_id, ".", -1), r"__[a-z]+$", "")


def absolute_path(root: str, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def reported_severity(severity: Column, category: Column) -> Column:
    """critical, high, medium or low: what isn't known is medium, and medium security findings are high."""
    upper = F.upper(F.coalesce(severity, F.lit("WARNING")))
    base = F.when(upper == "ERROR", "critical").when(upper == "INFO", "low").otherwise("medium")
    return F.when((base == "medium") & (category == "security"), "high").otherwise(base)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0).when(severity == "INFO", 2).otherwise(1)


def issue_id(scan_id: str, number: Column) -> Column:
    return F.format_string(f"{scan_id}-%04d", number)


def fallback_issue_id(file: Column, line: Column, rule_id: Column) -> Column:
    return F.concat_ws(":", file, line, rule_id)


def percent(ratio: Column) -> Column:
    """One decimal; halves go up on both engines that the queries are compared on."""
    return F.concat(F.format_string("%d.%d", F.floor(F.round(ratio * 1000) / 10).cast("int"), (F.round(ratio * 1000) % 10).cast("int")), F.lit("%"))


def pattern_regex(pattern: str, literal_blanks: bool = False) -> str | None:
    """A textual rule pattern as a regular expression: ``$NAME`` is a word, ``...`` anything, blanks and line ends are flexible.

    literal_blanks: leave blanks as they are escaped, with which patterns that hold any find nothing in ordinary code.
    """
    pattern = (pattern or "").strip()
    if not pattern or len(pattern) > 1000:
        return None
    out = []
    for part in re.findall(r"\$\w+|\.\.\.|[ \t]*\n[ \t]*|[ \t]+|.", pattern):
        if part[0] == "$" and len(part) > 1:
            out.append(r"\w+")
        elif part == "...":
            out.append(r"[\s\S]*?")
        elif "\n" in part:
            out.append(r"\\\n" if literal_blanks else r"\s*\n\s*")
        elif part.isspace():
            out.append(r"\\s+" if literal_blanks else r"\s+")
        else:
            out.append(re.escape(part))
    return "".join(out)
