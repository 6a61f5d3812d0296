"""Rule files to rules that run: profiles, compiled rules and their manifest, and the external engine's form of a rule."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators.match import FLAGS, TextRule
from lumensift.sources import rules_md
from lumensift.sources.rules_md import Rule


def rule_files(folder: str) -> list[str]:
    """Paths of a folder's rule files, relative to it: what the compiler reads, in order."""
    root = Path(folder)
    found = sorted(str(PurePosixPath(p.relative_to(root))) for p in root.rglob("*.md"))
    apart = ("compiled", "test-cases", "prompts")
    return [f for f in found if not any(a in f for a in apart) and not f.endswith("RULE-GENERATOR-GUIDE.md")]


def profile_specs(specs: DataFrame, rules: DataFrame) -> DataFrame:
    """(profile, path, rule_id, severity): the rules (path, rule_id, severity, enabled) that a profile's entries
    (profile, glob, enabled, severity_override) load. Both are dimensions of hundreds of rows."""
    specs = specs.where("coalesce(enabled, true)")
    regex = F.concat(F.lit("^"), F.replace(F.replace("glob", F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    specs = specs.withColumn("_rx", regex)
    rules = rules.where("coalesce(enabled, true)").where(F.col("path").endswith(".md"))
    joined = specs.join(rules, F.rlike(rules["path"], specs["_rx"]))
    return joined.select("profile", "path", "rule_id", F.coalesce("severity_override", "severity").alias("severity"))


def load_rules(folder: str, profile: dict | None = None, disabled: frozenset[str] = frozenset()) -> list[Rule]:
    """The rules of a folder that a profile switches on, file by file; without a profile those of all its rule files.

    Files that aren't there are passed over, and so are rules that are switched off, by their file or by ``disabled``.
    """
    root = Path(folder)
    specs = [{"path": f} for f in rule_files(folder)] if profile is None else profile.get("specs") or []
    out = []
    for spec in specs:
        if spec.get("enabled", True) is False:
            continue
        glob = spec["path"]
        paths = sorted(str(PurePosixPath(p.relative_to(root))) for p in root.glob(glob)) if "*" in glob else [glob]
        for path in paths:
            if not path.endswith(".md") or not (root / path).exists():
                continue
            for rule in rules_md.parse((root / path).read_text(encoding="utf-8", errors="replace")):
                if rule.enabled is False or rule.id in disabled:
                    continue
                if spec.get("severity_override"):
                    rule.severity = spec["severity_override"]
                out.append(rule)
    return out


def for_language(rule: Rule, language: str | None) -> list[tuple[str, str, str | None]]:
    """The patterns of a rule that are meant for a language: those under its heading, and those under none."""
    return [p for p in rule.patterns if not language or not p[2] or p[2] == language]


def _parted(rule: Rule) -> list[tuple[tuple[str, ...], list]]:
    """(languages, patterns) of a rule, language by language."""
    return [((lang,), for_language(rule, lang)) for lang in rule.languages] if len(rule.languages) > 1 else [(tuple(rule.languages), rule.patterns)]


def _runs(spark: SparkSession | None, regex: str) -> bool:
    """Whether an expression is one for both dialects: the driver's, whose syntax rules use, and the executors'."""
    try:
        re.compile(regex, re.DOTALL)
    except (re.error, OverflowError):
        return False
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(FLAGS + regex)
    except Exception:  # a PatternSyntaxException of the JVM
        return False
    return True


def compiled(rules: list[Rule], spark: SparkSession | None = None, literal_blanks: bool = False, by_language: bool = False) -> list[TextRule]:
    """Rules as expressions over whole texts. The last regular expression of a rule stands for all its patterns; a rule
    without a usable one is left out. by_language: patterns under a language's heading go for files of that language
    only, where else all languages of a rule share its expressions."""
    out = []
    for rule, own in [(r, p) for r in rules for p in (_parted(r) if by_language else [(tuple(r.languages), r.patterns)])]:
        languages, patterns = own
        kind = lambda k: [text for k_, text, _ in patterns if k_ == k]  # noqa: B023, E731
        given = kind("pattern-regex")
        regexes = given[-1:] or [T.pattern_regex(p, literal_blanks) for p in kind("pattern")]
        regexes = [r for r in regexes if r and _runs(spark, r) and not re.fullmatch(r, "", re.DOTALL)]
        nots = [r for r in (T.pattern_regex(p, literal_blanks) for p in kind("pattern-not")) if r and _runs(spark, r)]
        if regexes:
            out.append(TextRule(
                rule.id, str(rule.severity or "WARNING"), tuple(regexes), tuple(nots), languages, rule.category,
                str(rule.message or rule.title or ""), str(rule.fix or ""), tuple(sorted(rule.metadata.items())),
            ))
    return out


def engine_rule(rule: Rule, languages: list[str], name: str | None = None) -> dict:
    """A rule as the external engine reads it: one pattern, several as alternatives, exclusions beside them."""
    own = for_language(rule, languages[0] if len(languages) == 1 else None)
    kind = lambda k: [text for k_, text, _ in own if k_ == k]
    plain, apart, regex = kind("pattern"), [{"pattern-not": p} for p in kind("pattern-not")], kind("pattern-regex")[-1:]
    out = {"id": name or rule.id, "message": rule.message or rule.title or "Issue detected", "severity": rule.severity or "WARNING", "languages": languages}
    if regex:
        main = {"pattern-regex": regex[0]}
    elif len(plain) > 1:
        main = {"pattern-either": [{"pattern": p} for p in plain]}
    else:
        main = {"pattern": plain[0]} if plain else None
    if main:
        out |= {"patterns": [main, *apart]} if apart or "pattern-either" in main else main
    return out | ({"fix": rule.fix} if rule.fix else {}) | ({"metadata": rule.metadata} if rule.metadata else {})


def engine_rules(rules: list[Rule]) -> dict:
    """All rules for the external engine; one of several languages becomes one for each of them that has patterns."""
    out = []
    for rule in rules:
        if not rule.patterns:
            continue
        languages = rule.languages or ["java"]
        if len(languages) == 1:
            out.append(engine_rule(rule, languages))
        else:
            out += [engine_rule(rule, [lang], f"{rule.id}__{lang}") for lang in languages if for_language(rule, lang)]
    return {"rules": out}


# --- compiled rules and their manifest


def _hash(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def _manifest(folder: Path) -> dict:
    path = folder / "manifest.json"
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def _put(path: Path, value: dict) -> None:
    """A file comes to its place at once, or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    part.replace(path)


def compile_rules(folder: str, now: str, force: bool = False, target: str | None = None) -> list[Rule]:
    """The rules of all rule files, from ``compiled/`` where a file's hash is in the manifest, else parsed and written there.

    Rule files are a dimension of some hundred files that the driver holds anyway; now is what compiled_at says.
    """
    root, store = Path(folder), Path(target or Path(folder) / "compiled")
    manifest, out = _manifest(store), []
    for path in rule_files(folder):
        digest, place = _hash(root / path), store / f"{path}.json"
        if not force and (manifest.get(path) or {}).get("hash") == digest and place.exists():
            found = [Rule(**(r | {"patterns": [tuple(p) for p in r["patterns"]]})) for r in json.loads(place.read_text(encoding="utf-8"))["rules"]]
        else:
            found = rules_md.parse((root / path).read_text(encoding="utf-8", errors="replace"))
            entry = {"hash": digest, "compiled_at": now, "rules_count": len(found)}
            _put(place, {"source": path} | entry | {"rules": [asdict(r) for r in found]})
            manifest[path] = entry
            _put(store / "manifest.json", manifest)
        out += found
    return out


def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, compiled_at, rules_count) of the manifest in a folder of compiled rules."""
    rows = [(p, e.get("hash"), e.get("compiled_at"), e.get("rules_count")) for p, e in sorted(_manifest(Path(folder)).items())]
    return spark.createDataFrame(rows, "path string, hash string, compiled_at string, rules_count int")


def status_counts(status: DataFrame) -> DataFrame:
    """(total_files, cached_files, outdated_files): what was never compiled counts as outdated."""
    return status.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status") == "cached").alias("cached_files"), F.count_if(F.col("status") != "cached").alias("outdated_files"))

