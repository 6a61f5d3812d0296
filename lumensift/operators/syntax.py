"""Rules on syntax: six over the nodes of Java sources, four over whole texts of any language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.operators.match import TextRule, scan_texts
from lumensift.operators.tables import settled, ship
from lumensift.sources.files import newlines
from lumensift.sources.java import java_nodes, syntax_nodes

# Rule, severity, weakness and message of the six rules on nodes.
SYNTAX = {
    "xxe-java-document-builder-usage": ("ERROR", "CWE-611", "[XXE] DocumentBuilderFactory 未禁用外部实体，存在 XXE 注入风险。"),
    "sig-bypass-version-skip": ("CRITICAL", "CWE-345", "[签名绕过] 基于协议版本的条件分支跳过签名验证。"),
    "path-traversal-file-ops": ("ERROR", "CWE-22", "[路径穿越] 文件操作使用外部输入路径，可能存在路径穿越风险。"),
    "priv-java-runtime-exec": ("ERROR", "CWE-78", "[命令注入] Runtime.exec() 可能执行外部输入的命令。"),
    "sig-java-hardcoded-key": ("ERROR", "CWE-798", "[硬编码密钥] 签名密钥硬编码在源码中。"),
    "sig-java-weak-algorithm": ("ERROR", "CWE-328", "[签名绕过] 使用 MD5withRSA 签名算法，MD5 已被证明不安全。"),
}
# Words that the rules look for.
DISALLOW = "disallow-doctype-decl"
VERSION = r"\w*[Vv]ersion\w*\s*[<>=!]+\s*\d+"
VERIFIES = ["verifySignature", "checkHeaderSign", "verify", "checkSign", "validateSignature", "verifyDataStr"]
READS, TAINTED = ["read", "write", "parse", "load"], ["request", "param", "header", "getHeader", "getParameter"]

# The four rules on texts; the first is for Java, the third for XML.
SUPPLEMENTS = [
    TextRule("sig-bypass-version-check-regex", "WARNING", (r"if\s*\(\s*\w*[Vv]ersion\w*\s*[<>=!]+\s*\d+\s*\)\s*\{",), (), ("java",), None, "[签名绕过] 版本检查条件分支可能跳过签名验证。", "", (("cwe", "CWE-345"),)),
    TextRule("path-traversal-pattern", "WARNING", (r"(?:\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.\.%2f)",), (), (), None, "[路径穿越] 检测到路径穿越相关模式。", "", (("cwe", "CWE-22"),)),
    TextRule("sqli-mybatis-dollar", "ERROR", (r"\$\{[^}]+\}",), (), ("xml",), None, "[SQL 注入] MyBatis 使用 ${} 直接拼接 SQL，存在注入风险。", "", (("cwe", "CWE-89"),)),
    TextRule("hardcoded-password", "ERROR", (r"""(?:password|passwd|secret|api_key|apikey)\s*=\s*["'][^"']{4,}["']""",), (), (), None, "[硬编码密码] 代码中包含疑似硬编码的密码或密钥。", "", (("cwe", "CWE-798"),)),
]


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text.contains(w), F.lit(False))
    return out


def enclosing(nodes: DataFrame, every: DataFrame, kind: str) -> DataFrame:
    """nodes with the text of the method or the class around each (``method_text``, ``class_text``); null outside of one."""
    around = every.select("path", F.col("id").alias(kind), F.col("text").alias(f"{kind}_text"))
    return nodes.join(around, ["path", kind], "left")


def with_child(nodes: DataFrame, every: DataFrame, kind: str, name: str) -> DataFrame:
    """nodes with the text of their first child of a kind as a column."""
    child = every.where(F.col("type") == kind).groupBy("path", F.col("parent").alias("id")).agg(F.min_by("text", "id").alias(name))
    return nodes.join(child, ["path", "id"], "left")


def syntax_findings(nodes: DataFrame) -> DataFrame:
    """What the six rules find among the nodes of Java sources; nodes are read several times: give a written table."""
    calls = with_child(enclosing(enclosing(nodes.where("type = 'method_invocation'"), nodes, "method"), nodes, "class"), nodes, "argument_list", "args")
    made = with_child(nodes.where("type = 'object_creation_expression'"), nodes, "argument_list", "args")
    ifs = with_child(with_child(nodes.where("type = 'if_statement'"), nodes, "parenthesized_expression", "condition"), nodes, "block", "body")
    literal = nodes.where("type = 'string_literal'").select(F.col("path").alias("s_path"), F.col("start").alias("s_start"))
    keyed = made.where(F.col("text").contains("SecretKeySpec"))
    keyed = keyed.join(literal, (F.col("path") == F.col("s_path")) & F.col("s_start").between(F.col("start"), F.col("stop")), "left_semi")
    open_method = F.col("method_text").isNotNull() & ~F.col("method_text").contains(DISALLOW)
    open_class = F.col("class_text").isNotNull() & ~F.col("class_text").contains(DISALLOW)
    factory = (F.col("name") == "newInstance") & F.col("text").rlike(r"^[\w.]*DocumentBuilderFactory\s*\.") & open_method
    builder = (F.col("name") == "newDocumentBuilder") & open_method & open_class
    files = F.col("text").contains("new File(") | F.col("text").contains("new FileInputStream(")
    found = [
        ("xxe-java-document-builder-usage", calls.where(factory | builder), 200),
        ("sig-bypass-version-skip", ifs.where(F.col("condition").rlike(VERSION) & F.col("body").isNotNull() & ~_any_of(F.col("body"), VERIFIES)), 300),
        ("path-traversal-file-ops", calls.where(F.col("name").isin(READS) & _any_of(F.col("args"), TAINTED)), 200),
        ("path-traversal-file-ops", made.where(files & _any_of(F.col("args"), [*TAINTED, "path"]) & ~F.col("text").contains("..") & ~F.col("text").contains("normalize")), 200),
        ("priv-java-runtime-exec", calls.where((F.col("name") == "exec") & (F.col("text").contains("Runtime") | F.col("text").startswith("runtime."))), 200),
        ("sig-java-hardcoded-key", keyed, 200),
        ("sig-java-weak-algorithm", calls.where((F.col("name") == "getInstance") & F.col("args").contains("MD5withRSA")), 200),
    ]
    out = None
    for rule, rows, most in found:
        severity, cwe, message = SYNTAX[rule]
        own = rows.select(
            F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.col("path").alias("file"), "line", "end_line",
            F.left("text", F.lit(most)).alias("code_snippet"), F.lit("builtin-v2").alias("engine"), F.lit(cwe).alias("cwe"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def supplement_findings(files: DataFrame) -> DataFrame:
    """What the four rules find in files (path, text, lang)."""
    found = scan_texts(files, SUPPLEMENTS, "(?smU)")
    return found.select(
        "rule_id", "severity", "message", "file", "line", (F.col("line") + newlines(F.col("matched"))).cast("int").alias("end_line"),
        F.left("matched", F.lit(200)).alias("code_snippet"), F.lit("builtin-v2").alias("engine"), F.col("metadata")["cwe"].alias("cwe"),
    )


FOUND = "rule_id string, severity string, message string, file string, line int, end_line int, code_snippet string, engine string, cwe string"


def _check(batches: Iterator[pa.RecordBatch], check: Callable[[str, str, list[dict]], list[dict]]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in FOUND.split(", ")]
    kinds = {"line": pa.int32(), "end_line": pa.int32()}
    for batch in batches:
        rows = []
        for path, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            nodes = java_nodes(text or "") if lang == "java" else []
            rows += [{"file": path, "engine": "builtin-v2"} | found for found in check(path, text or "", nodes)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def checked(files: DataFrame, check: Callable[[str, str, list[dict]], list[dict]], languages: list[str] = ("java",)) -> DataFrame:
    """Findings of a rule of one's own: check(path, text, nodes) gives a file's findings, as many as there are, as dicts with
    any of the columns of FOUND. nodes are those of a Java source. No languages: files of all."""
    ship(files.sparkSession)
    own = files.where(F.col("lang").isin(list(languages))) if languages else files
    return own.select("path", "text", "lang").mapInArrow(partial(_check, check=check), FOUND)


def engine_scan(files: DataFrame) -> DataFrame:
    """All findings of the syntax engine in files (path, text, lang)."""
    return syntax_findings(settled(syntax_nodes(files))).unionByName(supplement_findings(files))
