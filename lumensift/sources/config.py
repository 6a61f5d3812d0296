"""Settings for the driver: block YAML, configuration, profiles, and the harness's switches. Data never comes this way."""

from __future__ import annotations

import re
from pathlib import Path

# The harness without a file is switched off.
HARNESS_OFF = {
    "harness": {
        "enabled": False,
        "decision_logging": {"enabled": False, "keep_recent": 10, "storage_dir": "data/decisions"},
        "feedback": {"enabled": False, "allow_batch": True, "storage_file": "data/feedbacks.json"},
        "auto_improvement": {"enabled": False},
        "quality_monitor": {"enabled": False, "cache_file": "data/stats_cache.json"},
    }
}

_KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s"'\[{#][^:]*?):(?:\s+(.*))?$""")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in re.findall(r""""[^"]*"|'[^']*'|[^,\[\]]+""", text[1:-1]) if x.strip()]
    if text == "{}":
        return {}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for rule, value in ((r"true", True), (r"false", False), (r"null|~|", None)):
        if re.fullmatch(rule, text, re.IGNORECASE):
            return value
    for rule, kind in ((r"[-+]?\d+", int), (r"[-+]?\d*\.\d+(e[-+]?\d+)?", float)):
        if re.fullmatch(rule, text, re.IGNORECASE):
            return kind(text)
    return text


def _plain(line: str) -> str:
    """The line without its comment."""
    quoted = None
    for i, c in enumerate(line):
        if quoted:
            quoted = None if c == quoted else quoted
        elif c in "\"'" and (i == 0 or line[i - 1] in " :-[,"):
            quoted = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


class _Reader:
    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.raw):
            line = _plain(self.raw[self.at]).rstrip()
            if line.strip() and not re.fullmatch(r"---|\.\.\.", line):
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    def block(self, indent: int):
        """The mapping, list or scalar whose lines are indented by ``indent``."""
        first = self.peek()
        if first[1].startswith("- ") or first[1] == "-":
            out = []
            while (now := self.peek()) and now[0] == indent and (now[1].startswith("- ") or now[1] == "-"):
                rest = now[1][1:].strip()
                inner = indent + len(now[1]) - len(rest) if rest else None
                if rest.startswith("- ") or _KEY.match(rest):  # a list or mapping that starts behind the dash
                    self.raw[self.at] = " " * inner + rest
                    out.append(self.block(inner))
                elif rest:
                    self.at += 1
                    out.append(_scalar(self.folded(rest, indent)))
                else:
                    self.at += 1
                    out.append(self.nested(indent))
            return out
        if not _KEY.match(first[1]):
            self.at += 1
            return _scalar(self.folded(first[1], indent - 1))
        found = {}
        while (now := self.peek()) and now[0] == indent and (m := _KEY.match(now[1])):
            self.at += 1
            key, value = str(_scalar(m[1])), (m[2] or "").strip()
            if re.fullmatch(r"[|>][-+]?", value):
                found[key] = self.literal(indent, value)
            elif value:
                found[key] = _scalar(self.folded(value, indent))
            else:
                found[key] = self.nested(indent)
        return found

    def nested(self, indent: int):
        now = self.peek()
        if now and (now[0] > indent or now[0] == indent and now[1].startswith("- ")):
            return self.block(now[0])
        return None

    def folded(self, value: str, indent: int) -> str:
        """A scalar with the lines that go on with it."""
        while (now := self.peek()) and now[0] > indent and not _KEY.match(now[1]) and not now[1].startswith("- "):
            value += " " + now[1]
            self.at += 1
        return value

    def literal(self, indent: int, style: str) -> str:
        rows = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip()) > indent):
            rows.append(self.raw[self.at])
            self.at += 1
        while rows and not rows[-1].strip():
            rows.pop()
        left = min((len(r) - len(r.lstrip()) for r in rows if r.strip()), default=0)
        text = ("\n" if style[0] == "|" else " ").join(r[left:] for r in rows)
        return text if style[1:] == "-" else text + "\n"


def load_yaml(text: str):
    """Block mappings and lists, flow lists, scalars that go over lines, and literal blocks; anchors and tags aren't read."""
    reader = _Reader(text)
    first = reader.peek()
    return reader.block(first[0]) if first else None


def dump_yaml(value, indent: int = 0) -> str:
    """Block style, keys in their order; load_yaml reads it back."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        rows = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            rows.append(f"{pad}{_shown(str(k))}:" + ("\n" + dump_yaml(v, indent + 2) if nested else f" {_shown(v, indent + 2)}"))
        return "\n".join(rows)
    if isinstance(value, list) and value:
        rows = []
        for v in value:
            if isinstance(v, (dict, list)) and v:
                rows.append(pad + "- " + dump_yaml(v, indent + 2)[indent + 2 :])
            else:
                rows.append(f"{pad}- {_shown(v, indent + 2)}")
        return "\n".join(rows)
    return pad + _shown(value)


def _shown(value, indent: int = 2) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if value == [] or value == {}:
        return "[]" if value == [] else "{}"
    if not isinstance(value, str):
        return str(value)
    if "\n" in value:
        return "|-\n" + "\n".join(" " * indent + r for r in value.split("\n"))
    safe = value and _scalar(value) == value and value.strip() == value and not re.search(r":(\s|$)|\s#|^[-?&*!|>%@`{}\[\],#]", value)
    return value if safe else (f"'{value}'" if "'" not in value else f'"{value}"')


def _read(path: Path):
    return load_yaml(path.read_text(encoding="utf-8")) if path.exists() else None


def load_config(path: str) -> dict:
    """The settings of a file; none if it isn't there."""
    return _read(Path(path)) or {}


def load_profile(folder: str, name: str) -> dict:
    """A profile of a rules folder; the default one if there is none of the name."""
    own = Path(folder) / "profiles"
    found = _read(own / f"{name}.yaml")
    return found if found is not None else _read(own / "default.yaml") or {}


def load_harness(path: str) -> dict:
    found = _read(Path(path))
    return found if found is not None else HARNESS_OFF


def prefilter_rules(config: dict) -> frozenset[str]:
    """Names of the prefilter's rules that a configuration leaves on."""
    own = config.get("prefilter") or {}
    return frozenset(k for k, v in (own.get("rules") or {}).items() if (v or {}).get("enabled", True)) if own.get("enabled", False) else frozenset()


def overlaid(standard: dict, *layers: dict | None) -> dict:
    """Parameters by workflow and caller: later layers win where they say anything."""
    out = dict(standard)
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out
