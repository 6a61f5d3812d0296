"""Java sources as a table of syntax nodes, found by matching brackets: what the syntax rules look at.

Not a parser: comments and strings are set aside, brackets are matched, and what stands before a bracket says what the
bracket belongs to. Unmatched brackets end with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.operators.tables import ship

SCHEMA = "path string, id int, parent int, method int, class int, type string, name string, start int, stop int, line int, end_line int, text string"
_FIELDS = pa.schema([("path", pa.string()), ("id", pa.int32()), ("parent", pa.int32()), ("method", pa.int32()), ("class", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]', re.DOTALL)
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]"}, {")": "(", "}": "{", "]": "["}
#: Words before a bracket that aren't names of methods.
_WORDS = {"if", "for", "while", "switch", "catch", "try", "synchronized", "return", "throw", "else", "do", "new", "assert", "case", "super", "this", "instanceof"}


def java_nodes(text: str) -> list[dict]:
    """Nodes of a source, outer ones first: type, name, start, stop (code points), and the places in the list of the
    parent, of the method and of the class around it, or None."""
    tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if not m[0].startswith(("//", "/*"))]
    word, at = [t[0] for t in tokens], {}
    stack = []
    for i, w in enumerate(word):
        if w in _OPEN:
            stack.append(i)
        elif w in _CLOSE:
            while stack and word[stack[-1]] != _CLOSE[w]:
                at[stack.pop()] = i
            if stack:
                at[stack.pop()] = i
    for i in stack:
        at[i] = len(tokens) - 1
    back = {j: i for i, j in at.items()}
    ident = lambda i: 0 <= i < len(word) and (word[i][0].isalpha() or word[i][0] in "_$")
    nodes = []

    def node(kind: str, name: str | None, first: int, last: int) -> None:
        nodes.append({"type": kind, "name": name, "start": tokens[first][1], "stop": tokens[min(last, len(tokens) - 1)][2]})

    def statement_begin(i: int) -> int:
        """The first token of what the one at i is part of."""
        while i > 0 and word[i - 1] not in (";", "{", "}"):
            i -= 1
        return i

    for i, w in enumerate(word):
        if w[0] in "\"'" and len(w) > 1:
            node("string_literal", None, i, i)
        elif w in ("class", "interface", "enum", "record") and ident(i + 1) and (i == 0 or word[i - 1] != "."):
            body = next((j for j in range(i + 2, len(word)) if word[j] in "{;"), None)
            if body is not None and word[body] == "{":
                node("class_declaration", word[i + 1], statement_begin(i), at[body])
        elif w == "{":
            node("block", None, i, at[i])
        elif w == "(" and ident(i - 1):
            name, close = word[i - 1], at[i]
            node("argument_list" if name not in _WORDS else "parenthesized_expression", None, i, close)
            if name == "if":
                after = close + 1
                if after < len(word) and word[after] == "{":
                    node("if_statement", None, i - 1, at[after])
                else:
                    end = next((j for j in range(after, len(word)) if word[j] == ";"), len(word) - 1)
                    node("if_statement", None, i - 1, end)
                continue
            if name in _WORDS:
                continue
            head = i - 1  # the name with what it is qualified by
            while head >= 2 and word[head - 1] == "." and (ident(head - 2) or word[head - 2] in (")", "]") or word[head - 2][0] == '"'):
                head -= 2
                while word[head] in (")", "]") and head in back:
                    head = back[head] - (1 if ident(back[head] - 1) else 0)
            before = word[head - 1] if head else ""
            if before == "new" and ")" not in word[head:i]:
                node("object_creation_expression", name, head - 1, close)
                continue
            body = close + 1
            if body < len(word) and word[body] == "throws":
                while body < len(word) and word[body] not in ("{", ";"):
                    body += 1
            typed = head == i - 1 and (before in (">", "]") or ident(head - 1) and before not in _WORDS)
            if body < len(word) and word[body] == "{" and (typed or before in ("{", "}", ";", "")):
                node("method_declaration" if typed and before not in ("public", "private", "protected") else "constructor_declaration", name, statement_begin(head), at[body])
            elif not (typed and body < len(word) and word[body] == ";" and _abstract(word, head)):
                node("method_invocation", name, head, close)
    nodes.sort(key=lambda n: (n["start"], -n["stop"]))
    open_: list[int] = []
    for k, n in enumerate(nodes):
        while open_ and nodes[open_[-1]]["stop"] < n["stop"]:
            open_.pop()
        n["parent"] = open_[-1] if open_ else None
        last = lambda *kinds: next((o for o in reversed(open_) if nodes[o]["type"] in kinds), None)
        n["method"], n["class"] = last("method_declaration", "constructor_declaration"), last("class_declaration")
        open_.append(k)
    return nodes


def _abstract(word: list[str], head: int) -> bool:
    """Whether the typed name is a declaration without a body, and not a call behind a keyword."""
    return head >= 2 and (word[head - 2] in ("abstract", "native", "public", "protected", "private", "static", "default", "final", "{", "}", ";"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            ends = [i for i, c in enumerate(text) if c == "\n"]
            rows = [
                n | {"path": path, "id": k, "line": 1 + bisect_left(ends, n["start"]), "end_line": 1 + bisect_left(ends, max(n["stop"] - 1, n["start"])), "text": text[n["start"] : n["stop"]]}
                for k, n in enumerate(java_nodes(text))
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def syntax_nodes(files: DataFrame) -> DataFrame:
    """The nodes of Java files (path, text, lang), one row each, numbered within their file with their parent's number."""
    ship(files.sparkSession)
    return files.where("lang = 'java'").select("path", "text").mapInArrow(_nodes, SCHEMA)
