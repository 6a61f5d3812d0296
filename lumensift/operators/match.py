"""Rules against lines and whole texts: each rule is a literal predicate behind a cheap test, and texts are read once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.functions.needles import matches, may_match, needles
from lumensift.sources.files import located


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    severity: str
    regex: str
    message: str = ""
    languages: tuple[str, ...] = field(default=())
    fix: str | None = None
    nots: tuple[str, ...] = field(default=())


def scan_lines(texts: DataFrame, rules: list[LineRule], text: str = "text") -> DataFrame:
    """A row per line and rule that matches: the other columns of texts, rule_id, severity, message, line, n_lines,
    n_matches, matched (the first match), code_snippet (five lines from the match on) and end_line.

    No shuffle: generators and filters inside one stage. A text is split into lines only if some rule may match in it,
    and a line is tried by a rule only if its text may match and the line holds what the rule's matches must hold.
    """
    others = [c for c in texts.columns if c != text]
    may = F.array(*[_in_text(F.col(text), r.regex) for r in rules])
    each = texts.select(*others, text, may.alias("_may"))
    each = each.select(*others, "_may", F.when(F.array_contains("_may", True), F.split(text, "\n", -1)).alias("ls"))
    each = each.select(*others, "_may", "ls", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("_pos", "txt"))
    found = [
        F.when(F.col("_may")[i] & matches(F.col("txt"), F.lower("txt"), r.regex), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"),
            F.regexp_count("txt", F.lit(r.regex)).cast("int").alias("n_matches"), F.regexp_extract("txt", r.regex, 0).alias("matched"),
        ))
        for i, r in enumerate(rules)
    ]
    hit = each.select(*others, "ls", "n_lines", (F.col("_pos") + 1).cast("int").alias("line"), F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("hit"))
    window = F.array_join(F.slice("ls", F.col("line"), 5), "\n")
    return hit.select(*others, "hit.*", "line", "n_lines", F.least(F.col("line") + 4, F.col("n_lines")).cast("int").alias("end_line"), window.alias("code_snippet"))


def _in_text(text: Column, regex: str) -> Column:
    """Whether a line of the text may match: exact for expressions that don't look beyond their match."""
    if needles(regex).context_free:
        return F.coalesce(matches(text, F.lower(text), regex), F.lit(False))
    cheap = may_match(text, F.lower(text), regex)
    return text.isNotNull() if cheap is None else F.coalesce(cheap, F.lit(False))


@dataclass(frozen=True)
class TextRule:
    """A rule over whole texts. nots look at what was matched."""

    rule_id: str
    severity: str
    regexes: tuple[str, ...]
    nots: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    category: str | None = None
    message: str = ""
    fix: str = ""
    metadata: tuple[tuple[str, str], ...] = ()


#: As rules are written for: the point takes in line ends, and classes are Unicode's.
FLAGS = "(?sU)"


def scan_texts(files: DataFrame, rules: list[TextRule], flags: str = FLAGS) -> DataFrame:
    """Findings of every match of every rule in whole files (path, text, lang): rule_id, category, severity, file, line,
    end_line, message, code_snippet (five lines), fix, metadata, matched, and regex_no and match_no, the order of matches.

    Texts are read once, however many rules there are: each expression is a literal behind a cheap test, and only for
    those that match in a file its matches are listed. No shuffle.
    """
    tests = [(r, n, regex) for r in rules for n, regex in enumerate(r.regexes)]
    if not tests:
        tests = [(TextRule("", "", ()), 0, "(?!)")]
    lang, text = F.col("lang"), F.col("text")
    hit = []
    for i, (rule, _, regex) in enumerate(tests):
        cheap = may_match(text, F.lower(text), regex)
        fits = text.rlike(flags + regex) if cheap is None else cheap & text.rlike(flags + regex)
        hit.append(F.when((F.coalesce(lang, F.lit("")).isin(list(rule.languages)) & fits) if rule.languages else fits, F.lit(i)))
    each = files.select("path", "text", F.explode(F.filter(F.array(*hit), lambda i: i.isNotNull())).alias("_test"))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("_test") + 1)
    regex = of([flags + regex for _, _, regex in tests], "string")
    places = located(each.withColumn("_regex", regex), F.col("text"), F.col("_regex"))
    nots = F.element_at(F.array(*[F.array(*[F.lit(flags + n) for n in r.nots]).cast("array<string>") for r, _, _ in tests]), F.col("_test") + 1)
    places = places.where(~F.exists(nots, lambda n: F.rlike(F.col("matched"), n)) if any(r.nots for r, _, _ in tests) else F.lit(True))
    ls = F.split("text", "\n", -1)
    metadata = F.element_at(F.array(*[F.create_map(*[F.lit(x) for kv in r.metadata for x in kv]).cast("map<string,string>") for r, _, _ in tests]), F.col("_test") + 1)
    return places.select(
        of([r.rule_id for r, _, _ in tests], "string").alias("rule_id"),
        F.coalesce(of([r.category for r, _, _ in tests], "string"), T.category(of([r.rule_id for r, _, _ in tests], "string"))).alias("category"),
        of([r.severity for r, _, _ in tests], "string").alias("severity"), F.col("path").alias("file"), "line",
        F.least(F.col("line") + 4, F.size(ls)).cast("int").alias("end_line"), of([r.message for r, _, _ in tests], "string").alias("message"),
        F.array_join(F.slice(ls, F.col("line"), 5), "\n").alias("code_snippet"), of([r.fix for r, _, _ in tests], "string").alias("fix"), metadata.alias("metadata"),
        "matched", of([n for _, n, _ in tests], "int").alias("regex_no"), F.col("k").alias("match_no"),
    )


def not_excluded(found: DataFrame, nots: list[str], matched: str = "matched") -> DataFrame:
    """Without the rows whose matched text (not the file) fits one of the exclusions."""
    for regex in nots:
        found = found.where(~F.col(matched).rlike(regex))
    return found


def rules_for_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files x rules where the rule's languages have the file's. rules is the rule dimension, small enough for
    Spark to broadcast it by its size."""
    return files.join(rules, T.language_matches(files["lang"], rules["languages"]))


def language_rules(rules: DataFrame) -> DataFrame:
    """Rules of several languages become one per language, named ``id__language``; those without a pattern go."""
    one = F.size("languages") <= 1
    usable = rules.where(F.col("n_pattern") + F.col("n_regex") > 0)
    each = usable.select("rule_id", "languages", F.explode_outer("languages").alias("language"))
    return each.select(F.when(one, F.col("rule_id")).otherwise(F.concat_ws("__", "rule_id", "language")).alias("rule_id"), "language")


def flatten_engine(reports: DataFrame, json: str = "report") -> DataFrame:
    """Findings of an external engine's JSON output: a row per entry of ``results``."""
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,lines:string>>>>"
    each = reports.select(F.explode(F.from_json(F.col(json), schema)["results"]).alias("r"))
    return each.select(
        T.normal_rule_id(F.col("r.check_id")).alias("rule_id"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.end.line").alias("end_line"),
        F.col("r.extra.message").alias("message"), F.col("r.extra.severity").alias("severity"), F.col("r.extra.lines").alias("code_snippet"),
    )


def restore_snippets(findings: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """findings (key, line) with the lines from one before to two after, stripped, 300 characters at most."""
    split = texts.select(key, F.split("text", "\n", -1).alias("ls"))
    first = F.greatest(F.col("line") - 1, F.lit(1))
    window = F.array_join(F.slice("ls", first, F.col("line") + 3 - first), "\n")
    return findings.join(split, key).select(*findings.columns, F.left(T.stripped(window), F.lit(300)).alias("restored"))
